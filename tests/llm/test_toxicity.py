import numpy as np
import pyarrow as pa

from sectionwise.llm import toxicity
from sectionwise.llm.wordhash import buffers

SYMBOLS, SEPARATORS = b"@43!10$57+*", b".-_*"
LEET = dict(zip(b"@43!10$57+", b"aaeiiosstt", strict=True))


def letter(c):
    return 65 <= c <= 90 or 97 <= c <= 122 or c >= 128


def in_word(c):
    return letter(c) or 48 <= c <= 57


def lower(bs):
    out = bytearray(bs)
    for i, c in enumerate(bs):
        if 65 <= c <= 90 or (i and bs[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
            out[i] += 32
    return bytes(out)


def slow_words(bs, cjk=True):
    out, w = [], bytearray()
    for i, c in enumerate(bs):
        own = cjk and (0xE3 <= c <= 0xED or (i >= 3 and 0xE3 <= bs[i - 3] <= 0xED and in_word(c)))
        if w and (own or not in_word(c)):
            out.append(lower(bytes(w)))
            w = bytearray()
        if in_word(c):
            w.append(c)
    return out + ([lower(bytes(w))] if w else [])


def slow_unbent(bs):
    at = lambda i: bs[i] if 0 <= i < len(bs) else 0
    near = lambda c: letter(c) or c in SYMBOLS
    seen = []
    for i, c in enumerate(bs):
        inner = near(at(i - 1)) and near(at(i + 1))
        lone = not (i >= 2 and in_word(at(i - 2))) or not (i + 2 < len(bs) and in_word(at(i + 2)))
        x = LEET.get(c, c) if inner or (48 <= c < 58 and c in SYMBOLS) else c
        x += 32 if 65 <= x <= 90 else 0
        seen.append((x, not (c in SEPARATORS and inner and (lone or c == 42))))
    return bytes(x for i, (x, keep) in enumerate(seen) if keep and not (i and x == seen[i - 1][0] and letter(x) and x < 128))


def slow_features(text, stems=()):
    bs = text.encode()
    ws = slow_words(bs)
    n, size = max(1, len(ws)), max(1, len(bs))
    insult, second = {w.encode() for w in toxicity.INSULTS}, {w.encode() for w in toxicity.SECOND}
    squeeze = toxicity._squeeze
    bent = {squeeze(w) for w in toxicity.INSULTS if len(w) > 3} | {squeeze(w[:i] + w[i + 1 :]) for w in toxicity.INSULTS if len(w) > 4 and w.isascii() for i in range(1, len(w) - 1) if w[i] in "aeiou"}
    bent = {w.encode() for w in bent} | insult
    hit = [w in insult for w in ws]
    plain = sum(hit)
    odd = max(0, sum(w in bent for w in slow_words(slow_unbent(bs))) - plain)
    runs = slow_words(bs, cjk=False)
    stem = [any(len(w) >= k and w[:k] in stems for k in toxicity.STEM_BYTES) for w in runs]
    spot = max([sum(m[i : i + toxicity.WINDOW]) for m in (hit, stem) for i in range(len(m)) if m[i]], default=0)
    close = sum(h and any(w in second for w in ws[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, h in enumerate(hit))
    punct = lambda c: 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127
    inner = sum(c in SYMBOLS and letter(bs[i]) and letter(bs[i + 2]) for i, c in enumerate(bs[1:-1]))
    return [plain * 100 / n, odd * 100 / n, sum(stem) * 100 / max(1, len(runs)), plain + odd, spot, sum(w in second for w in ws) * 100 / n, close * 100 / n, sum(65 <= c <= 90 for c in bs) / size, sum(map(punct, bs)) / size, bs.count(b"!") / size, inner * 100 / n, len(ws)]


def samples(n, seed=6):
    """(texts, toxic): invented words; every fourth text has four words of a vocabulary that the lexicon hasn't, or bent ones."""
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for i in range(n):
        w = [f"w{rng.integers(0, 500)}" for _ in range(80)]
        if i % 4 == 0:
            for k in rng.choice(80, 4, replace=False):
                w[k] = ("glorbwit", "snarfling", "1d10t", "m-o-r-o-n")[int(rng.integers(0, 4))]
        texts.append(" ".join(w))
        y.append(i % 4 == 0)
    return texts, np.array(y)


def test_features_against_plain_loops():
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    bits = ["you ", "idiot ", "1d10t", "m-o-r-o-n ", "stuuupid ", "id*ot", " ", "A", "B!", "é", "É", "漢", "字", "!", ".", "-", "*", "0", "4", "a", "trash ", "tes ", "\n"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(500)] + ["", "...", None, "you " + "x " * 60 + "idiot", "x" * 5000]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    data, off = buffers(pa.array(texts))
    h, _ = toxicity.stems(*buffers(pa.array(["idi", "tra", "wort"])))
    stem = {b"idi": h[0, 0], b"tra": h[1, 0], b"wort": h[2, 1]}
    got = toxicity.features(data, off, toxicity.Table(np.array(list(stem.values()), np.uint64)))
    for t, x in zip(texts, got, strict=True):
        assert np.allclose(x, slow_features(t or "", stem)), t


def test_held_out_and_edge_rows(spark):
    texts, y = samples(900)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, ""), (901, None), (None, "..."), (902, "x" * 300_000), (902, "x" * 300_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d = d.withColumn("y", d.doc_id).withColumn("part", d.doc_id).withColumn("i_", d.doc_id)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y[:600])] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    assert model.trees is not None
    got = [(r["doc_id"], r["score"], r["toxic"]) for r in toxicity.score(d, model).collect()]
    assert len(got) == len(rows)
    held = [(y[i], t) for i, _, t in got if i is not None and 600 <= i < 900]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all(s == 0 and not t for i, s, t in got if i in (900, 901, None))
    assert len({s for i, s, _ in got if i == 902}) == 1
    assert toxicity.score(d.limit(0), model).count() == 0
    bare = toxicity.train(d, labels.limit(0))
    assert bare.trees is None and [r["toxic"] for r in toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), bare).orderBy("doc_id").collect()] == [True, False]
    assert toxicity.train(d.limit(0), labels).trees is None


def test_stems_against_plain_loops(spark):
    texts, y = samples(400, 9)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    part = {r["doc_id"] for r in labels.where("pmod(xxhash64(doc_id, 'part'), 100) < 40").collect()}
    seen = [{}, {}]
    for i in part:
        for s in {w[:k] for w in slow_words(texts[i].encode(), cjk=False) for k in toxicity.STEM_BYTES if len(w) >= k}:
            seen[int(y[i])][s] = seen[int(y[i])].get(s, 0) + 1
    bad = sum(bool(y[i]) for i in part)
    want = {s for s, n in seen[1].items() if n >= toxicity.STEM_TOXIC and n / bad >= toxicity.STEM_RATIO * (seen[0].get(s, 0) + 0.5) / (len(part) - bad)}
    h, _ = toxicity.stems(*buffers(pa.array(sorted(w.decode() for w in want))))
    own = sorted(int(h[i, len(w) - 3]) for i, w in enumerate(sorted(want)))
    assert want and toxicity.train(d, labels).stems.tolist() == own


def test_isotonic_is_monotone():
    rng = np.random.default_rng(7)
    f = rng.normal(size=400)
    edges, p = toxicity.isotonic(f, (rng.random(400) < 1 / (1 + np.exp(-f))).astype(float))
    assert (np.diff(p) > 0).all() and (np.diff(edges) > 0).all()
