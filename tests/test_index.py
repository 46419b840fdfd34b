import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sectionwise.operators import search, structure
from sectionwise.store import Store

CHUNKS = "id long, document_id long, section_number string, title string, content string"


def some_chunks(n):
    r = random.Random(n)
    words = ["alpha", "beta", "Ünder", "中文", "x1", *[f"w{k}" for k in range(300)]]
    text = lambda most: " ".join(r.choices(words, k=r.randrange(most)))
    return [(3 * i + 1, r.choice((5, 2**40, 7)), r.choice(("1", "2.10", None, "附录", "")), text(4), text(400)) for i in range(n)] + [(10**12, 9, "0", None, None), (10**12 + 1, 9, "0", "", "- -")]


@pytest.mark.parametrize("segment, read", [(500, 300), (2_000_000, 4_000_000)])
def test_packed_index_equals_plain_postings(spark, monkeypatch, segment, read):
    monkeypatch.setattr(search, "SEGMENT", segment)
    monkeypatch.setattr(search, "READ", read)
    chunks = spark.createDataFrame(some_chunks(200), CHUNKS)
    want = {(r["term"], r["chunk_id"], r["document_id"], r["section_number"], r["col"], tuple(r["positions"])) for r in search.postings(chunks).collect()}
    packed = spark.createDataFrame(search.pack(chunks.repartition(3, "id")).collect(), search.PACKED)
    got = [(*r[:5], tuple(r[5])) for r in search.unpack(packed).collect()]
    assert len(got) == len(want) and set(got) == want
    tally = search.tally(packed).groupBy("chunk_id").agg({"n": "sum"}).collect()
    assert sum(r[1] for r in tally) == len(want) and len(tally) == len({w[1] for w in want})


def test_segment_of_no_terms():
    empty = pa.table({"id": pa.array([1]), "document_id": pa.array([1]), "section_number": ["1"], "title": pa.array([[]], pa.list_(pa.string())), "content": pa.array([[]], pa.list_(pa.string()))})
    assert search.pack_segment(empty) is None


def test_index_is_made_without_a_shuffle(spark):
    plan = search.pack(spark.createDataFrame(some_chunks(5), CHUNKS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_save_keeps_one_copy_of_the_chunks(spark, tmp_path):
    """Neither the copy that numbers are taken from nor more than one file of a bucket and task stays."""
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(f"d{i}", f"f{i}", []) for i in range(40)], "document_key string, filename string, tags array<string>")
    chunks = spark.createDataFrame([(f"d{i}", k, str(k), "T", "some words here", 1) for i in range(40) for k in range(3)], "document_key string, seg int, number string, title string, content string, page_start int")
    assert store.save(docs, chunks).count() == 40
    texts = [p for p in (tmp_path / "s/data").rglob("*.parquet") if "content" in pq.read_schema(p).names]
    assert len(texts) == 16 and all("chunks" in p.parts for p in texts)
    assert sorted(r["id"] for r in store.table("chunks").collect()) == list(range(1, 121))
    store.delete(3)
    store.compact()
    assert store.index_counts() == {"postings": 117 * 4, "indexed_chunks": 117, "chunks": 117} and store.search("words_here", limit=5000).count() == 117


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_save_shuffles_the_texts_once(spark, tmp_path):
    """As lines; not as titles beside them, nor again as chunks."""
    r = random.Random(1)
    docs = spark.createDataFrame([(f"d{i}", f"f{i}", []) for i in range(40)], "document_key string, filename string, tags array<string>")
    rows = [(f"d{i}", n, 1, ("# " if n % 3 == 0 else "") + f"{r.getrandbits(2400):x}") for i in range(40) for n in range(90)]
    lines = spark.createDataFrame(rows, "document_key string, line_no int, page int, line string")
    before = shuffled(spark)
    Store(spark, str(tmp_path / "s")).save(docs, structure.chunks(lines, docs))
    assert 0 < shuffled(spark) - before < 1.25 * sum(len(x[3]) for x in rows)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_numbers_of_chunks_written_by_several_tasks(spark, tmp_path, kind):
    """Against a plain loop: a document without lines, one without a row in documents, and places with gaps."""
    key = int if kind == "long" else str
    docs = spark.createDataFrame([(key(i), f"f{97 * i % 100:02}", []) for i in range(60)], f"document_key {kind}, filename string, tags array<string>")
    rows = [(key(i), 5 * n + i % 3, str(n), "T", f"text {i} {n}", 1) for i in range(65) if i != 9 for n in range(1 + i % 4)]
    random.Random(2).shuffle(rows)
    chunks = spark.createDataFrame(rows, f"document_key {kind}, seg int, number string, title string, content string, page_start int").repartition(7)
    store = Store(spark, str(tmp_path / "s"))
    ids = {r["document_key"]: r["id"] for r in store.save(docs, chunks).collect()}
    order = sorted((f"f{97 * i % 100:02}", i) for i in range(60))
    assert ids == {key(i): n for n, (_, i) in enumerate(order, 1)}
    said = [(i, x[4]) for _, i in order for x in sorted((x for x in rows if x[0] == key(i)), key=lambda x: x[1])]
    want = [(n, ids[key(i)], text) for n, (i, text) in enumerate(said, 1)]
    assert sorted((r["id"], r["document_id"], r["content"]) for r in store.table("chunks").collect()) == want
    assert {r["id"]: r["chunk_count"] for r in store.table("documents").collect()}[ids[key(9)]] == 0
