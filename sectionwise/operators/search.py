"""Keyword search over chunks: tokens, phrases, scope, LIKE mode, snippets, top k."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Tokens after which a segment of the index is closed, and bytes of it that are read at once.
SEGMENT, READ = 2_000_000, 4_000_000
PACKED = "term string, numbers binary, sections binary"
POSTINGS = "term string, chunk_id long, document_id long, section_number string, col string, positions array<int>"
RESULT = ("id", "document_id", "section_number", "title", "page_start", "file_path", "document_name", "snippet")


def keywords(query: str, tokenize: bool = False) -> list[str]:
    """Words of a query; by default marks inside a word are left out (``power-management`` is one word)."""
    out = []
    for w in query.split():
        w = re.sub(r"[^\w一-鿿]", " " if tokenize else "", w)
        out += w.split()
    return out


def _phrase(ts: Column, words: Column, n: int) -> Column:
    """The token array contains the phrase's tokens next to each other."""
    if n == 1:
        return F.array_contains(ts, words[0])
    around = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return around(ts).contains(around(words))


def matches(query: str, columns: tuple[str, ...] = ("title", "content"), tokenize: bool = False) -> Column | None:
    """All keywords, each in any of the columns; None if there is nothing to look for. A keyword with ``_`` is a phrase; one without letters or digits matches nothing."""
    words = keywords(query, tokenize)
    if not words:
        return None
    out = F.lit(True)
    for w in words:
        n = len([t for t in re.split(r"[^\w]|_", w) if t])
        if not n:
            return F.lit(False)
        want = tokens(F.lit(w))
        hit = F.lit(False)
        for c in columns:
            hit = hit | _phrase(tokens(F.col(c)), want, n)
        out = out & hit
    return out


def snippet(content: Column, query: str, size: int = 64) -> Column:
    """``size`` words from the one with a keyword whose stretch has most distinct keywords, then the earliest; keywords in ``==``."""
    want = F.array_distinct(F.flatten(F.array(*[tokens(F.lit(w)) for w in keywords(query)] or [F.array().cast("array<string>")])))
    ws = F.filter(F.split(content, "(?U)\\s+"), lambda w: w != "")
    hit = F.transform(ws, lambda w: F.arrays_overlap(tokens(w), want))
    starts = F.filter(F.transform(hit, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    score = F.transform(starts, lambda i: F.struct((-F.size(F.array_intersect(want, F.flatten(F.transform(F.slice(ws, i + 1, F.lit(size)), tokens))))).alias("s"), i.alias("i")))
    at = F.coalesce(F.array_min(score)["i"], F.lit(0))
    part = F.transform(F.slice(ws, at + 1, F.lit(size)), lambda w: F.when(F.arrays_overlap(tokens(w), want), F.concat(F.lit("=="), w, F.lit("=="))).otherwise(w))
    text = F.concat(F.when(at > 0, "...").otherwise(""), F.array_join(part, " "))
    return F.when(F.coalesce(content, F.lit("")) == "", "").when(text.endswith("..."), text).otherwise(F.concat(text, F.lit("...")))


def search(chunks: DataFrame, documents: DataFrame, query: str, document_id: int | None = None, limit: int = 100, mode: str = "tokens", tokenize: bool = False) -> DataFrame:
    """chunks (id, document_id, section_number, title, content, page_start, file_path) and documents (id, filename, upload_time) -> RESULT, newest first."""
    if mode == "like":
        cond = F.ilike(F.col("title"), F.lit(f"%{query}%")) | F.ilike(F.col("content"), F.lit(f"%{query}%"))
        snip = F.substring("content", 1, 300)
        snip = F.when(snip == "", "").otherwise(F.concat(F.trim(F.replace(snip, F.lit("\n"), F.lit(" "))), F.lit("...")))
    else:
        cond, snip = matches(query, tokenize=tokenize), snippet(F.col("content"), query)
    x = chunks.where(F.lit(False) if cond is None else cond)
    if document_id is not None:
        x = x.where(F.col("document_id") == document_id)
    d = documents.select(F.col("id").alias("d_"), F.col("filename").alias("document_name"), "upload_time")
    x = x.join(d, F.col("document_id") == F.col("d_")).orderBy(F.desc("upload_time"), "section_number", "id").limit(max(1, int(limit)))
    return x.withColumn("snippet", snip).select(*RESULT, "upload_time")


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, document_id, section_number, col, positions: an inverted index, from one scan of the chunks."""
    said = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in ("title", "content")])
    x = chunks.select(F.col("id").alias("chunk_id"), "document_id", "section_number", F.explode(said).alias("x")).select("chunk_id", "document_id", "section_number", "x.col", F.posexplode("x.terms").alias("pos", "term"))
    return x.groupBy("term", "chunk_id", "document_id", "section_number", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each run of a size begins, and the end of the last."""
    return np.concatenate(([0], np.cumsum(sizes)))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew in each run."""
    return np.arange(sizes.sum()) - np.repeat(_starts(sizes)[:-1], sizes)


def _gaps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; the value itself where a run starts."""
    out = np.diff(x, prepend=0)
    out[starts] = x[starts]
    return out


def _sums(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = _starts(gaps)
    return total[1:] - np.repeat(total[_starts(sizes)[:-1]], sizes)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and where its rows start and end."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _to_varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last below 128; and where each number starts."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << 7 * k)
    at = _starts(size)
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[at[has] + k] = (x[has] >> np.uint64(7 * k)) & np.uint64(127) | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, at


def _from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        has = np.flatnonzero(ends - starts >= k)
        out[has] |= (data[starts[has] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out.astype(np.int64), ends


def pack_segment(chunks: pa.Table) -> pa.RecordBatch | None:
    """PACKED rows of chunks (id, document_id, section_number, and the terms of title and content). Of a term: the number of postings; gaps of chunk
    ids; gaps of document ids, signed; twice the number of positions, and 1 for content; gaps of positions. Sections end with 0xff, which UTF-8 hasn't; 0xfe is null."""
    chunks = chunks.sort_by("id").combine_chunks()
    ids, owners = (chunks[c].to_numpy().astype(np.int64) for c in ("id", "document_id"))
    # units: title and content of each chunk in turn
    lists = [chunks[c].combine_chunks() for c in ("title", "content")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    sizes = [np.asarray(x.value_lengths().fill_null(0)).astype(np.int64) for x in lists]
    code = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    unit = np.concatenate([np.repeat(2 * np.arange(len(ids)) + k, n) for k, n in enumerate(sizes)])
    position = np.concatenate([_within(n) for n in sizes])
    codes = np.asarray(code.indices).astype(np.int64)
    if not len(codes):
        return None
    order = np.lexsort((unit, codes))  # stable, so positions stay in order
    codes, unit, position = codes[order], unit[order], position[order]
    first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (unit[1:] != unit[:-1]))))  # of each posting
    many = np.diff(first, append=len(codes))
    owner = codes[first]
    head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))  # of each term
    n = np.diff(head, append=len(first))
    tokens_of = np.add.reduceat(many, head)
    at = _starts(1 + 3 * n + tokens_of)
    numbers = np.empty(at[-1], np.int64)
    numbers[at[:-1]] = n
    k = np.repeat(at[:-1] + 1, n) + _within(n)
    width = np.repeat(n, n)
    chunk = unit[first] >> 1
    numbers[k] = _gaps(ids[chunk], head)
    signed = _gaps(owners[chunk], head)
    numbers[k + width] = np.where(signed < 0, -2 * signed - 1, 2 * signed)
    numbers[k + 2 * width] = 2 * many + (unit[first] & 1)
    numbers[np.repeat(at[:-1] + 1 + 3 * n, tokens_of) + _within(tokens_of)] = _gaps(position, first)
    data, ends = _to_varints(numbers)
    said = pa.array([b"\xfe\xff" if x is None else x.encode() + b"\xff" for x in chunks["section_number"].to_pylist()], pa.binary()).take(pa.array(chunk))
    letters, places = _bytes_of(said)
    return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(owner[head])), _binary(data, ends[at]), _binary(letters, places[np.append(head, len(first))])], ["term", "numbers", "sections"])


def unpack_rows(term: pa.Array, packed: pa.Array, sections: pa.Array) -> pa.RecordBatch:
    """POSTINGS of PACKED rows."""
    data, begins = _bytes_of(packed)
    x, ends = _from_varints(data)
    at = np.searchsorted(ends, begins[:-1])
    n = x[at]
    k = np.repeat(at + 1, n) + _within(n)
    width = np.repeat(n, n)
    signed = x[k + width]
    kind = x[k + 2 * width]
    many = kind >> 1
    tokens_of = np.diff(_starts(many)[_starts(n)])
    position = _sums(x[np.repeat(at + 1 + 3 * n, tokens_of) + _within(tokens_of)], many)
    letters, _ = _bytes_of(sections)
    stop = np.flatnonzero(letters == 255)
    cut = np.concatenate(([0], stop - np.arange(len(stop)))).astype(np.int32)
    said = _binary(letters[letters != 255], cut)
    said = pa.array([None if s == b"\xfe" else s.decode() for s in said.to_pylist()], pa.string()) if (letters == 254).any() else said.cast(pa.string())
    columns = [term.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(_sums(x[k], n)), pa.array(_sums(np.where(signed & 1, -(signed + 1) // 2, signed // 2), n)), said, pa.array(["title", "content"]).take(pa.array(kind & 1))]
    columns.append(pa.ListArray.from_arrays(pa.array(_starts(many).astype(np.int32)), pa.array(position.astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in POSTINGS.split(", ")])


def pack(chunks: DataFrame) -> DataFrame:
    """PACKED: the rows of ``postings``, those of a term together in each segment of some millions of tokens. Segments are made where the chunks lie, without a shuffle."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += sum(len(b.column(c).flatten()) for c in ("title", "content"))
            if n >= SEGMENT:
                yield pack_segment(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack_segment(pa.Table.from_batches(held))

    return chunks.select(F.col("id").cast("long"), F.col("document_id").cast("long"), "section_number", *[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(c) for c in ("title", "content")]).mapInArrow(run, PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """POSTINGS of PACKED rows, some megabytes at a time."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            part = _bytes_of(b.column("numbers"))[1][:-1] // READ
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                x = b.slice(i, j - i)
                yield unpack_rows(*(x.column(c) for c in ("term", "numbers", "sections")))

    return packed.select("term", "numbers", "sections").mapInArrow(run, POSTINGS)


def tally(packed: DataFrame) -> DataFrame:
    """chunk_id, document_id, n: postings of each chunk, a row a chunk and part of a segment."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = unpack_rows(b.column("term"), b.column("numbers"), b.column("sections"))
                at, first, n = np.unique(x["chunk_id"].to_numpy(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), x["document_id"].take(pa.array(first)), pa.array(n)], ["chunk_id", "document_id", "n"])

    return packed.select("term", "numbers", "sections").mapInArrow(run, "chunk_id long, document_id long, n long")


def find_phrases(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """chunk_id, document_id, section_number of the chunks that have all phrases, each within one column. A phrase without terms is nowhere."""
    if not all(phrases):
        return index.select("chunk_id", "document_id", "section_number").where("false")
    phrases = sorted(set(map(tuple, phrases)))
    places: dict[str, list[tuple[int, int, int]]] = {}
    for k, p in enumerate(phrases):
        for at, t in enumerate(p):
            places.setdefault(t, []).append((k, at, len(p)))
    lists = F.lit(None)
    for t, at in places.items():
        lists = F.when(F.col("term") == t, F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("at"), F.lit(n).alias("n")) for k, i, n in at])).otherwise(lists)
    x = index.where(F.col("term").isin(list(places))).select("chunk_id", "document_id", "section_number", "col", "positions", F.explode(lists).alias("x"))
    starts = F.when(F.col("x.n") == 1, F.array(F.lit(0))).otherwise(F.transform("positions", lambda i: i - F.col("x.at")))
    x = x.select("chunk_id", "document_id", "section_number", "col", "x.phrase", "x.n", F.explode(starts).alias("start"))
    # a term stands once at a place, so the rows of a start are the phrase's terms in order
    x = x.groupBy("chunk_id", "document_id", "section_number", "col", "phrase", "n", "start").agg(F.count("*").alias("c")).where("c = n")
    x = x.groupBy("chunk_id", "document_id", "section_number").agg(F.count_distinct("phrase").alias("k"))
    return x.where(F.col("k") == len(phrases)).select("chunk_id", "document_id", "section_number")


def search_postings(index: DataFrame, query: str) -> DataFrame:
    """chunk_id, document_id of the chunks that have all keywords; one with ``_`` is a phrase."""
    words = keywords(query)
    phrases = index.sparkSession.range(1).select(F.array(*[tokens(F.lit(w)) for w in words] or [F.array().cast("array<string>")])).first()[0]
    return find_phrases(index, phrases).select("chunk_id", "document_id")
