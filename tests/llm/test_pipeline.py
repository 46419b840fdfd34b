import corpus_pipeline as pipeline
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sectionwise.llm import mixing, packing, quality

from .test_dedup import brute_groups
from .test_llm import slow_pack
from .test_pii import brute


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_against_brute_force(spark):
    """All five stages on sf0.001: DuckDB for rules and mixing, all pairs, plain rewriting, one packed list."""
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in pipeline.run(spark, sf).collect()), key=repr)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    kept = c.execute(quality.quality_sql(final=f"SELECT {', '.join(COLUMNS)} FROM judged WHERE reasons = ''")).to_arrow_table().to_pylist()
    assert 0 < len(kept) < pq.read_metadata(f"{sf}/documents.parquet").num_rows
    group = brute_groups([r["doc_id"] for r in kept], [r["text"] for r in kept])
    kept = [r for r in kept if group[r["doc_id"]] == r["doc_id"]]
    texts = brute([r["text"] for r in kept])[0]
    kept = [r | {"text": t, "n_chars": len(t)} for r, t in zip(kept, texts, strict=True)]
    c.register("rewritten", pa.Table.from_pylist(kept))
    chosen = c.execute(mixing.mixing_sql("rewritten", "SELECT doc_id, text FROM chosen")).fetchall()
    assert 0 < len(chosen) < 2 * len(kept)
    assert got == slow_pack(chosen, packing.CAPACITY)


ODD = [(i, f"plain words in row {i} of the table", "en", "src1", 30) for i in range(30)]
ODD += [(1, "plain words in row 1 of the table", "en", "src1", 30), (None, None, None, None, None), (None, "", None, None, None), (70, "mail a@b.org now please do", None, None, 5), (71, "long text " * 50_000, "de", "src9", 1), (72, "...", "fr", "zz", 3)]


@pytest.mark.parametrize("stage", range(4))
def test_stages_pass_columns_and_odd_rows(spark, stage):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(k) for k, n in enumerate(("__m", "__q", "__n", "h_", "kind", "key", "domain", "epoch", "group_id", "tokens"))})
    name, run = pipeline.STAGES[stage]
    got = run(spark, d, "")
    assert got.columns == d.columns and got.count() <= 2 * len(ODD)
    ids = {r["doc_id"] for r in got.collect()}
    assert 70 in ids or name.startswith(("quality", "mixing"))
    assert run(spark, d.limit(0), "").count() == 0


def test_packing_stage_on_odd_rows(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumn("seq_id", F.lit(1))
    rows = pipeline.packing(spark, d, "").collect()
    assert {r["doc_id"] for r in rows} == set(range(30)) | {70, 71}
    assert not pipeline.packing(spark, d.limit(0), "").count()
