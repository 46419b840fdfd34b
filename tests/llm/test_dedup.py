import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionwise.llm import dedup
from sectionwise.llm.wordhash import buffers, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, D_ string"


def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, None, None, None, None, None), (None, "", None, None, None, None)], DOCS)


def words(rng, n):
    return [f"w{rng.integers(0, 500)}" for _ in range(n)]


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_within():
    rng = np.random.default_rng(2)
    for _ in range(150):
        a, b = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(1, 30))
        t, d = int(rng.integers(0, 20)), brute_edit(a, b)
        assert dedup.edit_within(a, b, t) == min(d, t + 1)


def test_near_dedup_groups_and_recall(spark):
    rng = np.random.default_rng(4)
    base = [words(rng, 120) for _ in range(30)]
    texts, want = [" ".join(b) for b in base], []
    for i, b in enumerate(base[:20]):
        c = list(b)
        for k in rng.choice(120, 8, replace=False):
            c[k] = "changed"
        want.append((i, len(texts)))
        texts.append(" ".join(c))
    texts += [texts[0], "", "short one", "short one"]
    d = docs(spark, texts)
    g = {r["doc_id"]: r["group_id"] for r in dedup.groups(d).collect()}
    assert sum(g.get(b) == a for a, b in want) >= 0.9 * len(want)
    assert g[50] == 0 and g[53] == 52 and not any(20 <= k < 30 for k in g)
    kept = dedup.keep_one(d)
    assert kept.columns == d.columns and {None, 51} <= {r["doc_id"] for r in kept.collect()}
    assert dedup.keep_one(d.limit(0)).count() == 0


def test_near_dedup_recall_by_length(spark):
    """Pairs of similarity 0.75 to 0.90: every one of short texts, 99 in 100 of the others at each length."""
    texts, want = [], {}
    for n in (4, 5, 8, 12, 20, 27, 60, 200):
        rng = np.random.default_rng(n)
        for lost in range(int(np.ceil(0.1 * n)), int(0.25 * n) + 1):
            for _ in range(60 if n < 60 else 20):
                b = [f"v{n}x{x}" for x in rng.integers(0, 20_000, n)]
                c = list(b)
                for k in rng.choice(n, lost, replace=False):
                    c[k] = f"x{rng.integers(0, 20_000)}"
                if 0.75 <= 1 - brute_edit(b, c) / n <= 0.90:
                    want.setdefault(n, []).append((len(texts), len(texts) + 1))
                    texts += [" ".join(b), " ".join(c)]
    got = {(r["a"], r["b"]) for r in dedup.near_edges(docs(spark, texts))[1].collect()}
    for n, pairs in want.items():
        assert len(pairs) >= 40 and sum(p in got for p in pairs) >= (1 if n <= 26 else 0.99) * len(pairs), n


def test_near_dedup_chains_of_drifting_copies(spark):
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(60):  # A and C are not similar; B, which is close to A, links C
        b = [f"v{x}" for x in rng.integers(0, 20_000, 200)]
        at = rng.permutation(200)
        a, c = list(b), list(b)
        for i, k in enumerate(at[:53]):
            (a if i < 4 else c)[k] = f"x{rng.integers(0, 20_000)}"
        texts += [a, b, c]
    g = {r["doc_id"]: r["group_id"] for r in dedup.groups(docs(spark, [" ".join(t) for t in texts])).collect()}
    assert sum(g.get(i + 2) == i for i in range(0, 180, 3)) >= 0.9 * 60


def test_near_dedup_short_texts_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(25):
        b = [f"v{x}" for x in rng.integers(0, 30, rng.integers(2, 27))]
        texts.append(b)
        for _ in range(4):
            c = list(b)
            for _ in range(rng.integers(1, 5)):
                k = int(rng.integers(0, len(c)))
                c[k : k + int(rng.integers(0, 2))] = [f"v{x}" for x in rng.integers(0, 30, rng.integers(0, 2))]
                c = c or ["v0"]
            texts.append(c)
    names = [" ".join(t) for t in texts]
    d = docs(spark, names)
    g = {r["doc_id"]: r["group_id"] for r in dedup.groups(d).collect()}
    for i, a in enumerate(texts):
        for j in range(i):
            if 1 - brute_edit(a, texts[j]) / max(len(a), len(texts[j])) >= 0.75:
                assert g.get(i, i) == g.get(j, j)


def brute_groups(ids, texts):
    """doc_id -> least doc_id of its group, from all pairs; a pair that shares too few words isn't aligned."""
    import pyarrow as pa

    data, off = buffers(pa.array(texts))
    h, w = word_hashes(data, off)
    ws = [h[w[i] : w[i + 1]] for i in range(len(texts))]
    _, code = np.unique(h, return_inverse=True)
    bags = np.zeros((len(texts), code.max() + 1), np.int16)
    np.add.at(bags, (np.repeat(np.arange(len(texts)), np.diff(w)), code), 1)
    n = np.diff(w)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        if not n[i]:
            continue
        least = np.minimum(bags[i], bags[:i]).sum(1)
        longer = np.maximum(n[i], n[:i])
        for j in np.flatnonzero((n[:i] > 0) & (least >= 0.75 * longer - 1e-9)):
            limit = int(0.25 * longer[j] + 1e-9)
            if dedup.edit_within(ws[i], ws[j], limit) <= limit:
                a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
                root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op3_against_all_pairs(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = brute_groups(t["doc_id"], [x or "" for x in t["text"]])
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in dedup.op3_near_dedup(spark, f"/root/testdata/{sf}").collect()}
    assert got == {i: (g, g == i) for i, g in want.items()} and len(set(want.values())) < len(want)


def test_small_blocks_give_the_same_groups(spark, monkeypatch):
    """Copies, strays and texts that share a passage only, in buckets of many blocks."""
    rng = np.random.default_rng(21)
    passage, texts = words(rng, 60), []
    for _ in range(25):
        texts.append(passage + words(rng, 25))
    for _ in range(6):
        b = words(rng, 80)
        for _ in range(12):
            c = list(b)
            c[int(rng.integers(0, 80))] = f"x{rng.integers(0, 99)}"
            texts.append(c)
    d = docs(spark, [" ".join(t) for t in texts])
    want = brute_groups(list(range(len(texts))), [" ".join(t) for t in texts])
    for block, led in ((16_384, 64), (3, 2)):
        monkeypatch.setattr(dedup, "BLOCK", block)
        monkeypatch.setattr(dedup, "LED", led)
        got = {r["doc_id"]: r["group_id"] for r in dedup.groups(d).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_repeated_ids_clashing_names_and_a_long_text(spark):
    long = "w1 w2 w3 " * 200_000
    rows = [(1, "one two three four"), (1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (3, long), (4, long + "end"), (5, "..."), (5, "..."), (None, "one two three four")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__dropped": F.lit(1), "__again": F.lit(2), "__n": F.lit(3), "rep": F.lit(4)})
    kept = dedup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5, 5]
