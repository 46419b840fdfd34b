"""A two-level index of WARC captures.

1. Pages are written as WARC response records, each its own gzip member, one file a task.
2. Captures (url key, page id, file, offset, length) are range-sorted by key and page over the whole data set, so that the
   captures of a hot key spread over several files. A key is
   the host reversed, then the path and query, without scheme, ``www.``, default port and fragment:
   ``com,example,blog)/en/1?page=2``. Each sorted partition becomes a file of zlib blocks of BLOCK lines.
3. The sparse directory has one row a block: its first key, file, offset and length.
4. A look-up takes each distinct key once and sends it to the key ranges of the index's files that may hold it (one
   boundary a file). A task then bisects the directory of its own range, inflates a block once for all its keys, bisects
   its lines, goes on to the next blocks while the key goes on, and range-reads the records.

No task holds more of the directory than its range has: one row for BLOCK captures; hits are passed on as they are found.

Defined results: a null or empty url, or one without a host, has the key ``-`` and is indexed by it; repeated rows
and equal keys are captures of their own, ordered by page id, nulls first; null html is an empty record; very long pages are
kept whole; an empty table gives an empty index, in which nothing is found; a query that isn't there gives a row with null
page_id; other columns don't matter.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, new_folder, read

BLOCK = 3000


def url_key(url: Column) -> Column:
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^(?:[^/?]*@)?([^/?:]*)", 1))
    host = F.regexp_replace(host, "^www\\.", "")
    port = F.regexp_extract(u, "^(?:[^/?]*@)?[^/?:]*:([0-9]+)", 1)
    rest = F.regexp_extract(u, "^[^/?]*(.*)$", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    name = F.array_join(F.reverse(F.split(host, "\\.")), ",")
    name = F.when((port == "") | port.isin("80", "443"), name).otherwise(F.concat(name, F.lit(":"), port))
    return F.when(host == "", F.lit("-")).otherwise(F.concat(name, F.lit(")"), rest))


def record(url: str | None, page_id: int | None, html: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {(url or '').replace('\r', '').replace('\n', '')}\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n"
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(head.encode() + html + b"\r\n\r\n") + c.flush()


def payload(member: bytes) -> bytes:
    raw = zlib.decompress(member, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    return body[: int(head.rpartition(b"Content-Length: ")[2])]


def _store(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One WARC file an attempt: a lost attempt's file is left unreferenced."""
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name, out, at = f"{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", None, 0
        for b in batches:
            starts, sizes = [], []
            for i, u, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = record(u, i, h.as_py() or b"")
                out.write(data)
                starts.append(at)
                sizes.append(len(data))
                at += len(data)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([name] * n, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["page_id", "key", "warc", "start", "length"])
        if out is not None:
            out.close()

    return write


def _blocks(folder: str, block: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, name = task.partitionId(), f"{task.partitionId():05d}-{task.taskAttemptId()}.idx"
        fs, root = pafs.FileSystem.from_uri(folder)
        out, at, lines, rows = None, 0, [], []

        def close(lines: list[str]) -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            rows.append((part, len(rows), lines[0].split("\t", 1)[0], name, at, len(data), len(lines)))
            at += len(data)

        for b in batches:
            lines += ["\t".join("" if v is None else str(v) for v in r) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            full = len(lines) // block * block
            for k in range(0, full, block):
                close(lines[k : k + block])
            lines = lines[full:]
        if lines:
            close(lines)
        if out is not None:
            out.close()
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "block", "first_key", "file", "start", "length", "n"])

    return write


def _escaped(url: Column) -> Column:
    """Keys in lines: tab, newline and backslash would break them."""
    return F.replace(F.replace(F.replace(F.replace(url, F.lit("\\"), F.lit("%5C")), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))


def build(pages: DataFrame, block: int = BLOCK, parts: int | None = None) -> tuple[str, DataFrame]:
    """Writes WARC files and index; gives (folder, directory: part, block, first_key, file, start, length, n)."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), _key_of(F.col("url")).alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    captures = durable(x.mapInArrow(_store(f"{folder}/data"), "page_id long, key string, warc string, start long, length long"), "captures")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select("key", "page_id", "warc", "start", "length").repartitionByRange(n, "key", "page_id", "warc", "start").sortWithinPartitions("key", "page_id", "warc", "start")
    return folder, durable(ordered.mapInArrow(_blocks(f"{folder}/index", block), "part int, block int, first_key string, file string, start long, length long, n int"), "directory")


_FOUND = "key string, rng int, hits long, page_id long, part int, block int, warc string, start long, length long, html_bytes long, digest string"
_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def _search(folder: str, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows rng, kind, key, file, start, length, part, block: a range's blocks (kind 0) in order, then the keys asked for (kind 1)."""
        fs, root = pafs.FileSystem.from_uri(folder)
        rng, firsts, blocks, opened = None, [], [], (None, -1, [], [])
        handles: dict[str, object] = {}

        def fetch(kind: str, name: str, start: int, length: int) -> bytes:
            path = f"{root}/{kind}/{name}"
            if path not in handles:
                if len(handles) >= 64:
                    handles.pop(next(iter(handles))).close()
                handles[path] = fs.open_input_file(path)
            return handles[path].read_at(length, start)

        def matches(want: bytes) -> Iterator[tuple[int, bytes]]:
            """(block, line) of the captures. Equal keys may begin in the block before the first that starts with the key."""
            nonlocal opened
            k = max(0, bisect.bisect_left(firsts, want) - 1)
            while k < len(blocks) and firsts[k] <= want:
                if opened[:2] != (rng, k):
                    lines = zlib.decompress(fetch("index", *blocks[k][:3])).split(b"\n")
                    opened = (rng, k, lines, [x.partition(b"\t")[0] for x in lines])
                lines, keys = opened[2:]
                i = bisect.bisect_left(keys, want)
                while i < len(keys) and keys[i] == want:
                    yield k, lines[i]
                    i += 1
                if i < len(keys):
                    break
                k += 1

        def read(key: str, hits: int, k: int, line: bytes) -> tuple:
            _, page, warc, s, n = line.decode().split("\t")
            html = payload(fetch("data", warc, int(s), int(n)))
            return key, rng, hits, int(page) if page else None, *blocks[k][3:], warc, int(s), int(n), len(html), hashlib.md5(html, usedforsecurity=False).hexdigest()

        def found() -> Iterator[tuple]:
            nonlocal rng, firsts, blocks
            for b in batches:
                for r, kind, key, name, start, length, part, block in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                    if r != rng:
                        rng, firsts, blocks = r, [], []
                    if kind == 0:
                        firsts.append(key.encode())
                        blocks.append((name, start, length, part, block))
                        continue
                    n, last = 0, None
                    for last in matches(key.encode()):
                        n += 1
                        if every:
                            yield read(key, 1, *last)
                    if n and not every:
                        yield read(key, n, *last)

        rows = found()
        while out := list(itertools.islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], [f.split()[0] for f in _FOUND.split(", ")])

    return run


def _key_of(url: Column) -> Column:
    return _escaped(url_key(url.cast("string")))


def find(folder: str, directory: DataFrame, keys: DataFrame, every: bool) -> DataFrame:
    """keys: distinct ``key`` -> _FOUND: a row for each capture (``every``), or for each range that has some with their number and the last of them."""
    spark = keys.sparkSession
    # one boundary an index file: as many as spark.sql.shuffle.partitions, whatever the data's size
    files = directory.groupBy("part").agg(F.min("first_key").alias("k")).orderBy("part").collect()
    edges = spark.sparkContext.broadcast(([r["k"].encode() for r in files], [r["part"] for r in files]))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, parts = edges.value
        for b in batches:
            out = []
            for k in b.column(0).to_pylist() if parts else ():
                e = k.encode()
                out += [(parts[i], k) for i in range(max(0, bisect.bisect_left(firsts, e) - 1), bisect.bisect_right(firsts, e))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([k for _, k in out], pa.string())], ["rng", "key"])

    long = F.lit(0).cast("long")
    asked = keys.mapInArrow(ranges, "rng int, key string").select("rng", F.lit(1).alias("kind"), "key", F.lit("").alias("file"), long.alias("start"), long.alias("length"), F.lit(0).alias("part"), F.lit(0).alias("block"))
    own = directory.select(F.col("part").alias("rng"), F.lit(0).alias("kind"), F.col("first_key").alias("key"), "file", "start", "length", "part", "block")
    return asked.union(own).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rng").sortWithinPartitions("rng", "kind", "key", "block").mapInArrow(_search(folder, every), _FOUND)


def lookup(folder: str, directory: DataFrame, queries: DataFrame) -> DataFrame:
    """queries: query_id, url -> query_id, key, the number of captures of its key and the last of them, read from its WARC file."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), _key_of(F.col("url")).alias("key"))
    parts = find(folder, directory, q.select("key").distinct(), False)
    last = parts.groupBy(F.col("key").alias("k_")).agg(F.sum("hits").alias("captures"), F.max_by(F.struct("page_id", "warc", "start", "length", "html_bytes", "digest"), "rng").alias("x"))
    return q.join(last, F.col("key") == F.col("k_"), "left").select("query_id", "key", F.coalesce("captures", F.lit(0)).cast("long").alias("captures"), "x.*")


def captures(folder: str, directory: DataFrame, urls: DataFrame) -> DataFrame:
    """urls: url -> all captures of their keys, each once: key, page_id, html_bytes, digest as read from the WARC files."""
    return find(folder, directory, urls.select(_key_of(F.col("url")).alias("key")).distinct(), True).select("key", "page_id", "html_bytes", "digest")


def op10_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL of every page looked up in the index of all pages: all captures of its key, with the content as read back."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder, directory = build(pages)
    return captures(folder, directory, pages.select("url"))


def capture_sql() -> str:
    """DuckDB SQL of op10's rows."""
    return r"""
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u FROM pages),
b AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^(?:[^/?]*@)?([^/?:]*)', 1)), '^www\.', '') AS host, regexp_extract(u, '^(?:[^/?]*@)?[^/?:]*:([0-9]+)', 1) AS port, regexp_extract(u, '^[^/?]*(.*)$', 1) AS rest FROM a)
SELECT CASE WHEN host = '' THEN '-' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')'
  || CASE WHEN rest = '' THEN '/' WHEN rest LIKE '?%' THEN '/' || rest ELSE rest END END AS key, page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS html_bytes, md5(coalesce(html, '')) AS digest FROM b"""
