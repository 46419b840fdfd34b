"""Token ids as flat unsigned integer files with 64-bit document offsets, for memory mapping.

Each input partition becomes ``part-NNNNN.bin`` (little-endian uint16, uint32 where the vocabulary needs it) and
``part-NNNNN.off`` (int64: start of each document, counted from the whole data set's first token,
and the end). The partitions' bases are prefix sums of their token counts: one row a partition. A
task writes under a name of its attempt and renames, so a task that is run again after a lost
executor puts the same bytes in the same place. Tokens never pass through the driver or a shuffle.

Documents are in the order of the input's partitions. Encoding is byte-level BPE; each piece that
the pattern cuts is encoded once per task and then looked up.

Defined results: null and empty texts have 0 tokens and keep their place; a null doc_id is kept;
repeated rows are written as often as they occur; an empty table gives no files and no rows;
other columns don't matter.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, new_folder, read

VOCABULARY = os.environ.get("SECTIONWISE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FULL = regex.compile(PATTERN)
#: The same where a text has only ASCII without odd controls and Latin letters: Python's own engine is faster.
_LETTERS = "A-Za-zªºÀ-ÖØ-öø-ʯ"
_PLAIN_TEXT = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ʯ]*")
_PLAIN = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
CACHE = 400_000


class Encoder(dict):
    """Piece -> its ids as bytes, filled as pieces occur."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("sectionwise", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[piece] = np.array(self.core._encode_single_piece(piece), self.dtype).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        pieces = _PLAIN.findall(text) if _PLAIN_TEXT.fullmatch(text) else _FULL.findall(text)
        return b"".join(map(self.__getitem__, pieces))


def _writer(folder: str, vocabulary: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/part-{part:05d}"
        draft = f"{name}.{task.taskAttemptId()}"
        enc = Encoder(vocabulary)
        at, out, ids, counts = 0, None, [], []
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for r, text in enumerate(b.column(1)):
                t = text.as_py()
                if t:
                    data = enc.encode(t)
                    n[r] = len(data) // enc.dtype.itemsize
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{draft}.bin")
                    out.write(data)
            ids.append(b.column(0))
            counts.append(n)
        if out is not None:
            out.close()
        rows = sum(map(len, counts))
        if not rows:
            return
        if out is None:
            fs.create_dir(root, recursive=True)
            fs.open_output_stream(f"{draft}.bin").close()
        fs.move(f"{draft}.bin", f"{name}.bin")
        starts = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        for c, n in zip(ids, counts, strict=True):
            yield pa.RecordBatch.from_arrays([c, pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(at, at + len(n), dtype=np.int64)), pa.array(starts[at : at + len(n)]), pa.array(n)], ["doc_id", "part", "row", "start", "n_tokens"])
            at += len(n)

    return write


def _offset_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows part, offset, end, sorted by part and row: one .off file a part."""
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get().taskAttemptId()
        part, out, end = None, None, 0

        def close() -> None:
            if out is not None:
                out.write(np.array([end], "<i8").tobytes())
                out.close()
                fs.move(f"{root}/part-{part:05d}.{task}.off", f"{root}/part-{part:05d}.off")

        for b in batches:
            p, off, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)])) if len(p) else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if p[i] != part:
                    close()
                    part = int(p[i])
                    out = fs.open_output_stream(f"{root}/part-{part:05d}.{task}.off")
                out.write(off[i:j].astype("<i8").tobytes())
                end = int(off[j - 1] + n[j - 1])
        close()
        yield from ()

    return write


def tokenise(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> tuple[str, DataFrame]:
    """Writes the files; gives their folder and doc_id, part, row, offset (of the whole data set), n_tokens."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = durable(x.mapInArrow(_writer(folder, vocabulary), "doc_id long, part int, row long, start long, n_tokens long"), "token-rows")
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row an input partition
    base = sums.select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))
    placed = rows.join(F.broadcast(base), F.col("part") == F.col("part_")).select("doc_id", "part", "row", (F.col("base") + F.col("start")).alias("offset"), "n_tokens")
    # only ids and numbers move here; each part's rows come together in order
    placed.repartition("part").sortWithinPartitions("part", "row").select("part", "offset", "n_tokens").mapInArrow(_offset_writer(folder), "x int").write.format("noop").mode("overwrite").save()
    return folder, placed


class Mapped:
    """Documents of a folder by number, from memory-mapped files."""

    def __init__(self, folder: str, dtype: str = "<u2") -> None:
        root = folder.removeprefix("file://")
        names = sorted(x[:-4] for x in os.listdir(root) if x.endswith(".off"))
        self.offsets = [np.memmap(f"{root}/{x}.off", "<i8", "r") for x in names]
        self.tokens = [np.memmap(f"{root}/{x}.bin", dtype, "r") if os.path.getsize(f"{root}/{x}.bin") else np.zeros(0, dtype) for x in names]
        self.first = np.concatenate(([0], np.cumsum([len(o) - 1 for o in self.offsets]))).astype(np.int64)

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        p = int(np.searchsorted(self.first, i, side="right")) - 1
        o = self.offsets[p]
        k = i - self.first[p]
        return self.tokens[p][o[k] - o[0] : o[k + 1] - o[0]]


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(read(spark, sf_dir, "documents"))[1]
