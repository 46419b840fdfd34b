"""Quality rules with thresholds that adapt to each language and source.

Each document gets integer metrics over its whole text (shares in 1/10,000, lengths in 1/100):

- ``symbols``: characters other than letters, digits and white space, to all characters;
- ``capitals``: upper-case letters to all characters;
- ``word_len``: characters of words to words;
- ``repeated_words``: words equal to the word before, to words;
- ``repeated_lines``: non-empty lines that occur before, to non-empty lines;
- ``bars``: words without letter or digit, to words.

They come from array operations over a batch's UTF-8 bytes, in one pass.

A log-linear histogram is the quantile sketch: a value keeps its SIG_BITS leading bits, so a
quantile is at most 2**(1-SIG_BITS) too low, and sketches of any parts merge by adding counts, which makes
them independent of partitioning. Sketches per (lang, source) merge into those per lang and for
all. A group's quartiles are drawn towards those of its language by a weight of PRIOR documents, and those of the language
towards those of all: small groups follow what surrounds them, and no size makes a jump. The
fences are q25 - K*spread and q75 + K*spread with spread = max(q75 - q25, floor of the metric).
A document outside of any fence is rejected, so a clean group rejects none, whatever its level.

Defined results: a null or empty text, or one with no word, has no metrics and is rejected with
reason ``empty``; a value on a fence is accepted; null lang or source is a group of its own; repeated rows count as often as they
occur and share their fate; very long texts are measured whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, durable, fresh, read
from .wordhash import _R, _R_INV, _powers, buffers, chunks, mix64

SIG_BITS = 7
K = 4
PRIOR = 40
#: metric -> (least spread, sides)
METRICS = {"symbols": (300, "hi"), "capitals": (500, "hi"), "word_len": (100, "both"), "repeated_words": (300, "hi"), "repeated_lines": (1500, "hi"), "bars": (300, "hi")}


_LETTER, _NUMBER, _UPPER, _SPACE = 1, 2, 4, 8
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Flags by code point."""
    if not _classes:
        kinds = {"Lu": _LETTER | _UPPER, **dict.fromkeys(("Ll", "Lt", "Lm", "Lo"), _LETTER), **dict.fromkeys(("Nd", "Nl", "No"), _NUMBER)}
        table = np.array([kinds.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)], np.uint8)
        table[[9, 10, 13, 32]] = _SPACE
        _classes.append(table)
    return _classes[0]


def _characters(b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(flags of each character, byte offsets of the characters, None if each is a byte)."""
    table = _class_table()
    if not (b >= 128).any():
        return table[b], None
    at = np.flatnonzero((b & 0xC0) != 0x80)
    lead = b[at]
    c = lead.astype(np.int32)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        code = c[k] & (0x7F >> size)
        for j in range(1, size):
            code = code << 6 | (b[np.minimum(at[k] + j, len(b) - 1)] & 0x3F)
        c[k] = code
    return table[np.minimum(c, 0x10FFFF)], at


def _run_hashes(b: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes that begin at ``starts``."""
    v = np.where(inside, b.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _powers(_R, len(b))
    return mix64(np.add.reduceat(v, starts) * _powers(_R_INV, len(b))[starts])


def measure(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words by row, rows x METRICS) of the texts at ``off``."""
    b, rows = data[off[0] : off[-1]], off - off[0]
    n_rows = len(rows) - 1
    out = np.zeros((n_rows, len(METRICS)), np.int64)
    if not len(b):
        return np.zeros(n_rows, np.int64), out
    flags, at = _characters(b)
    ends = rows if at is None else np.searchsorted(at, rows)

    def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    space = flags == _SPACE
    start = ~space
    start[1:] &= space[:-1]
    first = ends[:-1][ends[:-1] < len(flags)]
    start[first] = ~space[first]
    starts = np.flatnonzero(start)
    size = np.diff(ends)
    words = np.searchsorted(starts, ends)
    n = np.diff(words)
    named = (flags & (_LETTER | _NUMBER)) != 0
    repeated, bars = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    if len(starts):
        byte = starts if at is None else at[starts]
        inside = (b != 32) & (b != 10) & (b != 9) & (b != 13)
        h = _run_hashes(b, inside, byte)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[words[:-1][words[:-1] < len(h)]] = False
        repeated = per_row(same, words)
        bars = per_row(np.add.reduceat(named.astype(np.int32), starts) == 0, words)
    feed = b == 10
    line = ~feed
    line[1:] &= feed[:-1]
    first = rows[:-1][rows[:-1] < len(b)]
    line[first] = ~feed[first]
    begins = np.flatnonzero(line)
    lines = np.searchsorted(begins, rows)
    n_lines, again = np.diff(lines), np.zeros(n_rows, np.int64)
    if len(begins) > n_rows:
        row = np.repeat(np.arange(n_rows), n_lines)
        key = _run_hashes(b, ~feed, begins) ^ mix64(row.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        twice = np.flatnonzero(key[order][1:] == key[order][:-1])
        again = np.bincount(row[order[1:][twice]], minlength=n_rows)
    w = np.maximum(n, 1)
    out[:] = np.stack([per_row(~named & ~space, ends) * 10_000 // np.maximum(size, 1), per_row((flags & _UPPER) != 0, ends) * 10_000 // np.maximum(size, 1), per_row(~space, ends) * 100 // w, repeated * 10_000 // w, again * 10_000 // np.maximum(n_lines, 1), bars * 10_000 // w], 1)
    return n, out


_STRUCT = "struct<" + ", ".join(f"{m}: bigint" for m in METRICS) + ">"


def _measured(texts: pa.Array) -> pa.Array:
    data, off = buffers(texts)
    parts = [measure(data, off[i : j + 1]) for i, j in chunks(off)]
    n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    x = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, len(METRICS)), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(METRICS))], list(METRICS), mask=pa.array(n == 0))


def metrics(text: Column) -> Column:
    """Struct of METRICS, or null where the text has no word. Marked as not deterministic so that no filter computes it again."""
    return F.arrow_udf(_measured, _STRUCT).asNondeterministic()(text.cast("string"))


def _bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - SIG_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """measured: lang, source and the metrics -> (lang, source, metric, bucket, n), per lang and source."""
    long = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("x"))
    return long.select("lang", "source", "x.metric", "x.bucket").groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    part = Window.partitionBy(*keys, "metric")
    upto = part.orderBy("bucket")
    x = sketch.withColumn("total", F.sum("n").over(part)).withColumn("upto", F.sum("n").over(upto))
    q = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))).alias(f"q{25 * k}") for k in (1, 3)]
    return x.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *q)


def thresholds(measured: DataFrame, prior: int = PRIOR, k: int = K) -> DataFrame:
    """One row a (lang, source): lo_<metric>, hi_<metric>; durable."""
    own = durable(sketches(measured), "quality-sketch")
    by_lang, by_all = merge(own, ["lang"]), merge(own, [])
    a = _quantiles(own, ["lang", "source"])
    b = _quantiles(by_lang, ["lang"]).select(F.col("lang").alias("l_"), F.col("metric").alias("m_"), *[F.col(c).alias("b" + c) for c in ("total", "q25", "q75")])
    c = _quantiles(by_all, []).select(F.col("metric").alias("m2_"), *[F.col(c).alias("c" + c) for c in ("total", "q25", "q75")])
    x = a.join(b, F.col("lang").eqNullSafe(F.col("l_")) & (F.col("metric") == F.col("m_"))).join(c, F.col("metric") == F.col("m2_"))

    def pick(q: str) -> Column:
        around = f"((btotal * b{q} + {prior} * c{q}) div (btotal + {prior}))"
        return F.expr(f"(total * {q} + {prior} * {around}) div (total + {prior})")

    x = x.select("lang", "source", "metric", pick("q25").alias("lo"), pick("q75").alias("hi"))
    least = F.lit(0)
    for m, (f, _) in METRICS.items():
        least = F.when(F.col("metric") == m, F.lit(f)).otherwise(least)
    spread = F.greatest(F.col("hi") - F.col("lo"), least)
    x = x.select("lang", "source", "metric", (F.col("lo") - k * spread).alias("lo"), (F.col("hi") + k * spread).alias("hi"))
    out = x.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(side))).cast("long").alias(f"{side}_{m}") for m in METRICS for side in ("lo", "hi")])
    return durable(out, "quality-thresholds")


def judge(docs: DataFrame, into: str, **args) -> DataFrame:
    """``docs`` with a struct ``into``: metrics, and ``reasons`` (array, empty if accepted).

    The metrics are computed twice, for the thresholds and for the verdict: that costs less than writing the texts between.
    """
    (m_,) = fresh(docs, "__m")
    return _judge_measured(docs.withColumn(m_, metrics(F.col("text"))), m_, into, **args)


def _judge_measured(docs: DataFrame, m_: str, into: str, **args) -> DataFrame:
    measured = docs.select("lang", "source", m_).where(F.col(m_).isNotNull()).select("lang", "source", f"{m_}.*")
    limits = thresholds(measured, **args)
    names = fresh(docs, "__l", "__s", *[f"__{s}_{m}" for m in METRICS for s in ("lo", "hi")])
    limits = limits.toDF(*names)
    side = dict(zip([(m, s) for m in METRICS for s in ("lo", "hi")], names[2:], strict=True))
    x = attach(docs, limits, [("lang", names[0]), ("source", names[1])], "left")
    reasons = [F.when(F.col(m_).isNull(), F.lit("empty"))]
    for m, (_, sides) in METRICS.items():
        v = F.col(f"{m_}.{m}")
        bad = v > F.col(side[m, "hi"])
        if sides == "both":
            bad = bad | (v < F.col(side[m, "lo"]))
        reasons.append(F.when(bad, F.lit(m)))
    x = x.withColumn(into, F.struct(*[F.col(f"{m_}.{m}").alias(m) for m in METRICS], F.array_compact(F.array(*reasons)).alias("reasons")))
    return x.drop(m_, *names[2:])


def accept(docs: DataFrame, **args) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    (q,) = fresh(docs, "__q")
    return judge(docs, q, **args).where(F.size(f"{q}.reasons") == 0).drop(q)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", metrics(F.col("text")).alias("m"))
    x = _judge_measured(durable(docs, "quality-metrics"), "m", "q")
    return x.select("doc_id", "lang", "source", *[f"q.{m}" for m in METRICS], F.array_join("q.reasons", ",").alias("reasons"))


def quality_sql(docs: str = "documents", final: str | None = None) -> str:
    """DuckDB SQL of op4's rows over any table of documents."""
    ms = list(METRICS)
    unpivot = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM measured WHERE n > 0" for m in ms)
    least = "CASE " + " ".join(f"WHEN metric = '{m}' THEN {f}" for m, (f, _) in METRICS.items()) + " END"
    sides = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {s} END) AS {s}_{m}" for m in ms for s in ("lo", "hi"))
    bad = ", ".join(f"CASE WHEN m.{m} > l.hi_{m}" + (f" OR m.{m} < l.lo_{m}" if METRICS[m][1] == "both" else "") + f" THEN '{m}' END" for m in ms)
    final = final or f"SELECT doc_id, lang, source, {', '.join(ms)}, reasons FROM judged"

    def q(name: str, source: str, keys: str) -> str:
        part = f"PARTITION BY {keys}metric"
        return f"""{name} AS (SELECT {keys}metric, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q25, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q75
  FROM (SELECT *, sum(n) OVER ({part}) AS total, sum(n) OVER ({part} ORDER BY bucket) AS upto FROM (SELECT {keys}metric, bucket, sum(n) AS n FROM {source} GROUP BY ALL)) GROUP BY {keys}metric)"""

    def pick(v: str) -> str:
        around = f"((b.total * b.{v} + {PRIOR} * c.{v}) // (b.total + {PRIOR}))"
        return f"CAST((a.total * a.{v} + {PRIOR} * {around}) // (a.total + {PRIOR}) AS BIGINT)"

    return f"""
WITH parts AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines FROM {docs}),
measured AS MATERIALIZED (SELECT * EXCLUDE (w, lines), len(w) AS n,
  CASE WHEN len(w) > 0 THEN CAST(floor(CAST(length(regexp_replace(text, '[\\p{{L}}\\p{{N}} \\n\\t\\r]+', '', 'g')) * 10000 AS DOUBLE) / length(text)) AS BIGINT) END AS symbols,
  CASE WHEN len(w) > 0 THEN CAST(floor(CAST(length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) * 10000 AS DOUBLE) / length(text)) AS BIGINT) END AS capitals,
  CASE WHEN len(w) > 0 THEN CAST(floor(CAST(length(regexp_replace(text, '[ \\n\\t\\r]+', '', 'g')) * 100 AS DOUBLE) / len(w)) AS BIGINT) END AS word_len,
  CASE WHEN len(w) > 0 THEN CAST(floor(CAST(len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2])) * 10000 AS DOUBLE) / len(w)) AS BIGINT) END AS repeated_words,
  CASE WHEN len(w) > 0 THEN CAST(floor(CAST((len(lines) - len(list_distinct(lines))) * 10000 AS DOUBLE) / len(lines)) AS BIGINT) END AS repeated_lines,
  CASE WHEN len(w) > 0 THEN CAST(floor(CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) * 10000 AS DOUBLE) / len(w)) AS BIGINT) END AS bars
  FROM parts),
long AS ({unpivot}),
sketch AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - {SIG_BITS}, 0)) << greatest(length(bin(v)) - {SIG_BITS}, 0) AS bucket, count(*) AS n FROM long GROUP BY ALL),
{q("qa", "sketch", "lang, source, ")}, {q("qb", "sketch", "lang, ")}, {q("qc", "sketch", "")},
picked AS (SELECT a.lang, a.source, a.metric,
  {pick("q25")} AS q25, {pick("q75")} AS q75
  FROM qa a JOIN qb b ON a.lang IS NOT DISTINCT FROM b.lang AND a.metric = b.metric JOIN qc c ON a.metric = c.metric),
fences AS (SELECT lang, source, metric, q25 - {K} * greatest(q75 - q25, {least}) AS lo, q75 + {K} * greatest(q75 - q25, {least}) AS hi FROM picked),
limits AS (SELECT lang, source, {sides} FROM fences GROUP BY lang, source),
judged AS (SELECT m.*, concat_ws(',', CASE WHEN m.n = 0 THEN 'empty' END, {bad}) AS reasons
  FROM measured m LEFT JOIN limits l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source)
{final}"""
