"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words, plain and obfuscated (``1d10t``, ``m-o-r-o-n``,
``idiooot``, ``id*ot``); of learned stems; the densest stretch of WINDOW words, so that long texts don't dilute;
second-person words, and hits within NEAR words of one; capitals, punctuation, exclamation and symbols
inside words. All of them are array operations over a batch's UTF-8 bytes.

Training takes at most TRAIN_ROWS labelled documents, those of least hash of doc_id, and divides them by hash:
part one gives the stems (word prefixes of 3 to 9 bytes that far more toxic than clean documents
have), part two the trees (second-order boosting on histograms), part three the calibration (pool
adjacent violators). Stems are counted and features made by tasks; the driver gets the stems that qualify and one
row of features a labelled document, no texts. Scoring covers all documents by a map; the model travels with the tasks.

Defined results: null, empty and wordless texts score 0 and aren't toxic; a label of null is no label; several
labels of one doc_id count as toxic if one is; without labels of both kinds the score is 0 or 1 by the built-in
lexicon's density alone; equal values of a feature go the same way in a tree; very long texts are read whole; rows are scored as often as they occur; null doc_id passes; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, read
from .wordhash import _IS_WORD, _LOWER, _R, _R_INV, _powers, buffers, chunks, mix64, word_hashes

TRAIN_ROWS = 30_000
THRESHOLD = 0.5
NEAR, WINDOW = 5, 50
STEM_BYTES = range(3, 10)
STEM_TOXIC, STEM_RATIO = 5, 20.0
ROUNDS, DEPTH, RATE, BINS, L2, LEAST = 80, 3, 0.15, 64, 1.0, 8

INSULTS = """idiot idiots moron morons scum clown clowns worthless pathetic trash disgusting stupid loser losers dumb dumbass imbecile
 cretin filth filthy garbage vermin parasite parasites subhuman retard retarded bastard bitch asshole jerk freak creep pig fool fools
 dummkopf trottel vollidiot abschaum arschloch wertlos erbärmlich widerlich dumm versager mistkerl schlampe dreckig
 imbécile crétin ordure salaud connard connasse débile minable dégoûtant pourriture abruti nul perdant
 imbécil estúpido estúpida basura escoria asqueroso patético inútil perdedor cabrón gilipollas idiota payaso""".split()
SECOND = """you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu toi te ton ta tes vous votre vos
 tú ti tus usted ustedes vosotros""".split()
FEATURES = ["lexicon", "obfuscated", "stems", "hits", "densest", "second", "near_second", "capitals", "punctuation", "exclamation", "inner_symbols", "words"]
VERDICT = ["score", "toxic"]


def _hashes(ws: list[str]) -> np.ndarray:
    data, off = buffers(pa.array([w for w in ws]))
    h, _ = word_hashes(data, off)
    return np.unique(h)


def _squeeze(w: str) -> str:
    return "".join(c for i, c in enumerate(w) if not i or c != w[i - 1])


class Table:
    """Set of 64-bit hashes: a bit map first, then the exact search for what passes."""

    def __init__(self, values: np.ndarray, bits: int = 20) -> None:
        self.values = np.unique(values.astype(np.uint64))
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[self.values & self.mask] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        flat = h.ravel()
        out = self.bits[flat & self.mask]
        if len(self.values):
            at = np.flatnonzero(out)
            k = np.minimum(np.searchsorted(self.values, flat[at]), len(self.values) - 1)
            out[at] = self.values[k] == flat[at]
        return out.reshape(h.shape)


_INSULTS = Table(_hashes(INSULTS))
_SECOND = Table(_hashes(SECOND))
#: As obfuscation leaves them: runs squeezed, and one inner vowel lost to a symbol.
_BENT = Table(_hashes(sorted({_squeeze(w) for w in INSULTS if len(w) > 3} | {_squeeze(w[:i] + w[i + 1 :]) for w in INSULTS if len(w) > 4 and w.isascii() for i in range(1, len(w) - 1) if w[i] in "aeiou"} - set(INSULTS))))
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"@43!10$57+", b"aaeiiosstt", strict=True):
    _LEET[_a] = _b
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[ord(c) for c in ".-_*"]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in "@43!10$57+*"]] = True
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[33:48] = _IS_PUNCT[58:65] = _IS_PUNCT[91:97] = _IS_PUNCT[123:127] = True


def _unbent(b: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with look-alikes put back, separators between single letters and stars in words left out, runs squeezed."""
    n = len(b)
    p1, n1 = np.zeros_like(b), np.zeros_like(b)
    p1[1:], n1[:-1] = b[:-1], b[1:]
    starts = rows[:-1][rows[:-1] < n]
    p1[starts], n1[starts[1:] - 1] = 0, 0  # a row's neighbours are its own
    inner = (_IS_LETTER[p1] | _IS_SYMBOL[p1]) & (_IS_LETTER[n1] | _IS_SYMBOL[n1])
    out = np.where(inner | (_IS_SYMBOL[b] & (b >= 48) & (b < 58)), _LEET[b], b)
    out = _LOWER[out]
    sep = np.flatnonzero(_IS_SEPARATOR[b] & inner)
    keep = np.ones(n, bool)
    if len(sep):
        row = np.searchsorted(rows, sep, side="right") - 1
        p2, n2 = b[np.maximum(sep - 2, 0)], b[np.minimum(sep + 2, n - 1)]
        lone = (~_IS_WORD[p2] | (sep - 2 < rows[row])) | (~_IS_WORD[n2] | (sep + 2 >= rows[row + 1]))
        keep[sep[lone | (b[sep] == 42)]] = False
    same = np.zeros(n, bool)
    same[1:] = (out[1:] == out[:-1]) & _IS_LETTER[out[1:]] & (out[1:] < 128)
    same[starts] = False
    keep &= ~same
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[rows]


def stems(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, words x lengths; row of each word). 0 where the word is shorter."""
    b = _LOWER[data[off[0] : off[-1]]]
    rows = off - off[0]
    n = len(b)
    hi = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)) + 1
    b[hi] += 32
    word = _IS_WORD[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = rows[:-1][rows[:-1] < n]
    start[first] = word[first]
    s = np.flatnonzero(start)
    row = np.searchsorted(rows, s, side="right") - 1
    if not len(s):
        return np.zeros((0, len(STEM_BYTES)), np.uint64), row
    stop = np.flatnonzero(np.append(~word, True))
    ends = np.minimum(stop[np.searchsorted(stop, s)], rows[row + 1])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(b.astype(np.uint64) * _powers(_R, n), out=total[1:])
    back = _powers(_R_INV, n)[s]
    out = np.zeros((len(s), len(STEM_BYTES)), np.uint64)
    for j, k in enumerate(STEM_BYTES):
        fits = ends - s >= k
        out[fits, j] = mix64((total[s[fits] + k] - total[s[fits]]) * back[fits] + np.uint64(k)) | np.uint64(1)
    return out, row


def _sums(hit: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(hit)))
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def features(data: np.ndarray, off: np.ndarray, learned: Table) -> np.ndarray:
    """Rows x FEATURES of the texts at ``off``."""
    raw = data[off[0] : off[-1]]
    rows = off - off[0]
    h, w = word_hashes(data, off)
    n = np.diff(w)
    per = 100 / np.maximum(n, 1)
    hit, second = _INSULTS.has(h), _SECOND.has(h)
    bent, brow = _unbent(raw, rows)
    bh, bw = word_hashes(bent, brow)
    plain_squeezed = _sums(hit, w)
    obfuscated = np.maximum(_sums(_BENT.has(bh) | _INSULTS.has(bh), bw) - plain_squeezed, 0)
    stem, row = stems(data, off)
    stemmed = learned.has(stem).any(axis=1)
    stem_off = np.searchsorted(row, np.arange(len(off)))
    size = np.maximum(np.diff(rows), 1)
    area = np.concatenate(([0], np.cumsum(hit)))
    at = np.arange(len(h))
    r = np.repeat(np.arange(len(n)), n)
    spot = np.zeros(len(n))
    marks = np.flatnonzero(hit)
    if len(marks):
        np.maximum.at(spot, r[marks], area[np.minimum(marks + WINDOW, w[r[marks] + 1])] - area[marks])
    stem_area = np.concatenate(([0], np.cumsum(stemmed)))
    marks = np.flatnonzero(stemmed)
    if len(marks):
        np.maximum.at(spot, row[marks], stem_area[np.minimum(marks + WINDOW, stem_off[row[marks] + 1])] - stem_area[marks])
    said = np.concatenate(([0], np.cumsum(second)))
    lo, hi = np.maximum(at - NEAR, w[r]), np.minimum(at + NEAR + 1, w[r + 1])
    near = hit & (said[hi] > said[lo]) if len(h) else hit
    upper = (raw >= 65) & (raw <= 90)
    punct = _IS_PUNCT[raw]
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = _IS_SYMBOL[raw[1:-1]] & _IS_LETTER[raw[:-2]] & _IS_LETTER[raw[2:]]
    edges = rows[rows < len(raw)]
    inner[edges], inner[edges[1:] - 1] = False, False
    stem_hits = _sums(stemmed, stem_off)
    x = [plain_squeezed * per, obfuscated * per, stem_hits * 100 / np.maximum(np.diff(stem_off), 1), plain_squeezed + obfuscated, spot, _sums(second, w) * per, _sums(near, w) * per, _sums(upper, rows) / size, _sums(punct, rows) / size, _sums(raw == 33, rows) / size, _sums(inner, rows) * per, n.astype(float)]
    return np.stack(x, 1)


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Second-order gradient boosting on histograms; trees are full arrays of depth DEPTH."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    for j, e in enumerate(edges):  # what is rare has no quantile of its own
        v = np.unique(x[:, j])
        edges[j] = np.unique(np.concatenate((e, v[np.linspace(0, len(v) - 1, 16).astype(int)])))
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    width = max(len(e) for e in edges) + 1
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    f = np.full(len(y), np.log(p0 / (1 - p0)))
    trees = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feat, cut = np.full((1 << DEPTH) - 1, -1), np.zeros((1 << DEPTH) - 1)
        for d in range(DEPTH):
            for k in range(1 << d):
                at = (1 << d) - 1 + k
                rows = np.flatnonzero(node == k)
                best, where = 1e-6, None
                if len(rows) >= 2 * LEAST:
                    for j in range(x.shape[1]):
                        c = np.bincount(b[rows, j], minlength=width)[:width].cumsum()
                        gs = np.bincount(b[rows, j], g[rows], minlength=width)[:width].cumsum()
                        hs = np.bincount(b[rows, j], h[rows], minlength=width)[:width].cumsum()
                        gain = gs**2 / (hs + L2) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + L2) - gs[-1] ** 2 / (hs[-1] + L2)
                        gain[(c < LEAST) | (c[-1] - c < LEAST)] = 0
                        m = int(gain[: len(edges[j])].argmax()) if len(edges[j]) else 0
                        if len(edges[j]) and gain[m] > best:
                            best, where = gain[m], (j, m)
                if where:
                    feat[at], cut[at] = where[0], edges[where[0]][where[1]]
                    node[rows] = 2 * k + (b[rows, where[0]] > where[1])
                else:
                    node[rows] = 2 * k
        leaf = -np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + L2) * RATE
        trees.append((feat, cut, leaf))
        f += leaf[node]
    return {"base": float(np.log(p0 / (1 - p0))), "trees": trees}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feat, cut, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for d in range(DEPTH):
            at = (1 << d) - 1 + node
            j = feat[at]
            node = 2 * node + ((j >= 0) & (x[rows, np.maximum(j, 0)] > cut[at]))
        f += leaf[node]
    return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least margins, probabilities), both ascending: pool adjacent violators, with one pseudo-count spread over a pool."""
    order = np.argsort(f, kind="stable")
    pools: list[list[float]] = []
    for v, t in zip(f[order], y[order], strict=True):
        if pools and pools[-1][0] == v:
            pools[-1][1] += t
            pools[-1][2] += 1
        else:
            pools.append([v, t, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


@dataclass
class Model:
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    trees: dict | None = None
    steps: tuple | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            out = (x[:, 0] + x[:, 1] >= 0.5).astype(float)
        else:
            k = np.searchsorted(self.steps[0], margin(self.trees, x), side="right") - 1
            out = self.steps[1][np.maximum(k, 0)]
        out[x[:, -1] == 0] = 0
        return out


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text, y -> stem, toxic and clean documents that have it; stem 0 stands for all documents."""
    for b in batches:
        data, off = buffers(b.column(0))
        y = b.column(1).to_numpy(zero_copy_only=False)
        seen: list[list[np.ndarray]] = [[], []]
        for i, j in chunks(off):
            h, row = stems(data, off[i : j + 1])
            bounds = np.searchsorted(row, np.arange(j - i + 1))
            for r in range(j - i):
                own = h[bounds[r] : bounds[r + 1]]
                seen[int(y[i + r] > 0)].append(np.unique(np.append(own[own > 0], np.uint64(0))))
        for k in (0, 1):
            if seen[k]:
                v, n = np.unique(np.concatenate(seen[k]), return_counts=True)
                none = np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n if k else none), pa.array(none if k else n)], ["stem", "toxic", "clean"])


def _features_of(learned: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(learned)
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in chunks(off):
                x = features(data, off[i : j + 1], table)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in (1, 2)), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(FEATURES)))], ["y", "part", *FEATURES])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of at most ``rows`` labelled documents. part: 0 for stems, 1 for trees, 2 for calibration."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("i_")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    turn = F.pmod(F.xxhash64("i_", F.lit("part")), F.lit(100))
    part = F.when(turn < 40, 0).when(turn < 80, 1).otherwise(2)
    ids = ids.orderBy(F.xxhash64("i_"), "i_").limit(rows).select("i_", "y", part.alias("part"))
    if rows <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    x = docs.select(F.col("doc_id").cast("long").alias("d_"), F.col("text").cast("string").alias("text")).where("text is not null").join(ids, F.col("d_") == F.col("i_"))
    x = durable(x.select("text", "y", "part"), "toxic-sample")
    counts = durable(x.where("part = 0").select("text", "y").mapInArrow(_count_stems, "stem long, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-stems")
    whole = counts.where("stem = 0").first()
    learned = np.zeros(0, np.uint64)
    if whole is not None and whole["toxic"]:
        often = F.col("toxic") / whole["toxic"] >= F.lit(STEM_RATIO) * (F.col("clean") + 0.5) / max(1, whole["clean"])
        learned = np.sort(np.array([r["stem"] for r in counts.where((F.col("stem") != 0) & (F.col("toxic") >= STEM_TOXIC) & often).select("stem").collect()], np.int64).view(np.uint64))
    got = x.where("part > 0").select("text", "y", "part").mapInArrow(_features_of(learned), "y int, part int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    cols = [got.column(k).to_numpy() for k in range(got.num_columns)]
    order = np.lexsort(cols)  # rows come as tasks end
    y, part, m = cols[0][order].astype(float), cols[1][order], np.stack([c[order] for c in cols[2:]], 1) if len(order) else np.zeros((0, len(FEATURES)))
    model = Model(learned)
    a, b = np.flatnonzero(part == 1), np.flatnonzero(part == 2)
    if all(0 < y[i].sum() < len(i) for i in (a, b)):
        model.trees = boost(m[a], y[a])
        model.steps = isotonic(margin(model.trees, m[b]), y[b])
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(model.stems)
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in chunks(off):
                x = features(data, off[i : j + 1], table)
                p = model.score(x)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(x[:, k]) for k in range(len(FEATURES))], pa.array(p), pa.array(p >= THRESHOLD)], ["doc_id", *FEATURES, *VERDICT])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, FEATURES, score, toxic of every row."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(_scorer(model), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", score double, toxic boolean")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
