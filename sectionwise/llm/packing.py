"""Packing along a space-filling curve.

1. A document's vector is the sum of its words' hashed signs in DIMS dimensions (a random
   projection of the hashed bag of words), divided by the number of words; the logistic curve maps
   each dimension to BITS bits. Whole texts, one pass, vectorised by batch.
2. The Hilbert index of that cell is the key. Documents are range-partitioned and sorted by
   (key, doc_id, tokens).
3. Their lengths (words plus one separator) laid end to end along the curve are cut each
   ``capacity`` tokens; a document that crosses a cut goes on in the next sequence. Positions are
   prefix sums: within each range partition and over the partitions' totals, so the result does
   not depend on how many partitions there are.

The result has one row for each piece: seq_id, slot (place in the sequence), doc_id, doc_start (in
words of the document, the separator being its last), n_tokens, hilbert.

Defined results: null, empty or wordless texts are not packed; a document longer than a
sequence fills several; a null doc_id sorts first and is packed; repeated rows are packed as often as
they occur; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read
from .wordhash import buffers, chunks, mix64, word_hashes

DIMS, BITS = 3, 12
CAPACITY = 2048
SHARPNESS = 6.0


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index (int64) of each row of non-negative ints below 2**bits, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(hashes: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """Cells (rows x DIMS) of documents given as word hashes and offsets."""
    n = np.diff(word_off)
    out = np.zeros((len(n), DIMS), np.int64)
    bits = mix64(hashes)
    for d in range(DIMS):
        # sums of 21-bit signed fields, exact integers
        v = ((bits >> np.uint64(21 * d)) & np.uint64(0x1FFFFF)).astype(np.int64) - 0x100000
        total = np.concatenate(([0], np.cumsum(v)))
        mean = (total[word_off[1:]] - total[word_off[:-1]]) / np.maximum(n, 1) / 0x100000
        out[:, d] = np.clip(np.floor((1 << BITS) / (1 + np.exp(-SHARPNESS * mean))), 0, (1 << BITS) - 1)
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b.column(1))
        for i, j in chunks(off):
            h, w = word_hashes(data, off[i : j + 1])
            n = np.diff(w)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.where(n > 0, n + 1, 0)), pa.array(hilbert(project(h, w)))], ["doc_id", "tokens", "hilbert"])


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, tokens (with the separator), hilbert of all documents that have words."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(_keys, "doc_id long, tokens long, hilbert long").where("tokens > 0")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    spark = docs.sparkSession
    keyed = durable(keys(docs), "pack-keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["hilbert", "doc_id", "tokens"]
    ranged = durable(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "pack-ranges")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition: as many as spark.sql.shuffle.partitions
    base = ranged.groupBy("part").agg(F.sum("tokens").alias("n")).select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(whole), F.lit(0)).cast("long").alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = ranged.withColumn("upto", F.sum("tokens").over(inside)).join(F.broadcast(base), F.col("part") == F.col("part_"))
    x = x.withColumn("at", F.col("base") + F.col("upto") - F.col("tokens"))
    cap = F.lit(capacity).cast("long")
    x = x.withColumn("seq_id", F.explode(F.sequence(F.expr(f"at div {capacity}"), F.expr(f"(at + tokens - 1) div {capacity}"))))
    start = F.greatest(F.col("at"), F.col("seq_id") * cap)
    end = F.least(F.col("at") + F.col("tokens"), (F.col("seq_id") + 1) * cap)
    return x.select("seq_id", (start - F.col("seq_id") * cap).alias("slot"), "doc_id", (start - F.col("at")).alias("doc_start"), (end - start).alias("n_tokens"), "hilbert")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
