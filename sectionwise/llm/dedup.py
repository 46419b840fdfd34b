"""Near duplicates by Order MinHash, verified by banded alignment.

1. One pass over whole texts gives each document its word hashes' digest and SKETCHES order
   vectors: of the k-mers of K words, each labelled with its number of occurrence, the L of least
   hash are sampled and kept in text order. Two documents agree in a vector with a probability
   that falls with their edit distance, also where only order differs.
2. Documents of equal digest are exact copies; only the one of least doc_id goes on.
3. Documents that agree in a vector share a bucket; texts of up to SHORT words also do by the k-mers that any text
   similar to them must share one of, so that none of their pairs is missed. Within a bucket the least doc_id leads: it is a candidate
   with every member whose length and bag of words allow the similarity: texts that alike share 3/5 of all their labelled words, so a one-permutation sketch of
   BAG bytes that lies three deviations under that rules a pair out. Those members leave with their leader; the rest
   follow a new leader, until none is left. So copies cost one candidate each, however many they are. A bucket of more than
   BLOCK members is led block by block, then the blocks' leaders likewise, in rounds.
   After alignment every bucket is gone through again: what verified edges have not joined to its largest group (its strays)
   is compared with all its members, strays and members in blocks of their own, so a task holds two blocks at most.
   So no member is dropped: there is no cap on buckets, partners or candidates. (A bucket of n texts of which no two
   are similar still costs n^2 comparisons of BAG bytes, spread over (n/BLOCK)^2 tasks.)
4. Candidates are aligned word by word, in a band as wide as the threshold allows, whose cells are bits of one integer a column.
   A leader's words are sent once for LED of its pairs. Similarity is 1 - distance / longer length; SIMILARITY or more is an edge.
5. Groups are the connected components (large-star/small-star rounds over durable tables).

The plan is the same at every size: no table is broadcast unless Spark finds it small by itself, and words always move by a shuffle.

Defined results: null doc_id or null, empty and wordless texts are in no group (``group_id`` is their
own doc_id; null for null) and are kept; rows that share a doc_id are one document, which any of its
texts can link, and one row of it stays; very long texts are aligned whole; an empty table gives an empty result; ties go to the least doc_id; other
columns pass through ``keep_one``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, durable, fresh, read
from .wordhash import buffers, chunks, mix64, word_hashes

K, L, SKETCHES = 2, 3, 96
SIMILARITY = 0.75
_MULT = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BAG = 64
#: Texts of up to so many words are paired exactly; the vectors are too few for them.
SHORT = 26
#: Members of a bucket that one task compares, and pairs of a leader that one task aligns.
BLOCK, LED = 16_384, 64


def labelled_kmers(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hashes, their hashes with number of occurrence, offsets by row). A row of fewer than K words has one k-mer of all its words."""
    n = np.diff(w)
    g = h.copy()
    for d in range(1, K):
        shifted = np.zeros_like(h)
        shifted[:-d] = h[d:] if len(h) > d else 0
        g = mix64(g * np.uint64(0xD6E8FEB86659FD93) + shifted)
    keep = np.ones(len(h), bool)
    for d in range(1, K):
        ends = w[1:][n > d] - d
        keep[ends] = False
    row = np.repeat(np.arange(len(n)), n)
    for d in np.flatnonzero((n > 0) & (n < K)):  # words of short rows: one k-mer, whatever follows
        keep[w[d] : w[d + 1]] = False
        keep[w[d]] = True
        g[w[d]] = mix64(np.array([int(x) for x in h[w[d] : w[d + 1]]], np.uint64)).sum(dtype=np.uint64)
    g, row = g[keep], row[keep]
    off = np.searchsorted(row, np.arange(len(n) + 1))
    key = g ^ mix64(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(g), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = np.arange(len(g))
    occ = np.empty(len(g), np.uint64)
    occ[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return g, mix64(g + occ * np.uint64(0xA24BAED4963EE407)), off


def bag_sketch(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows x BAG bytes: of each row's words with number of occurrence the least in each bin; 255 where a bin is empty."""
    row = np.repeat(np.arange(len(w) - 1), np.diff(w))
    key = h ^ mix64(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    new = np.ones(len(h), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = np.arange(len(h))
    occ = np.empty(len(h), np.uint64)
    occ[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    u = mix64(h + occ * np.uint64(0xA24BAED4963EE407))
    cell = row * BAG + (u & np.uint64(BAG - 1)).astype(np.int64)
    least = np.full((len(w) - 1) * BAG, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, cell, u >> np.uint64(6))
    out = (mix64(least) % np.uint64(255)).astype(np.uint8)
    out[least == np.iinfo(np.uint64).max] = 255
    return out.reshape(-1, BAG)


def bags_allow(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether the share of equal bins isn't three deviations under that of texts of just this similarity."""
    used = ((a != 255) | (b != 255)).sum(1)
    same = ((a == b) & (a != 255)).sum(1)
    p = similarity / (2 - similarity)
    return same >= p * used - 3 * np.sqrt(p * (1 - p) * used)


def pair_allowed(na: int | np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """bags_allow for longer texts. An edit changes two bins at most: texts of up to SHORT words are ruled out by that alone, which misses none."""
    most = np.maximum(na, nb)
    return np.where(most <= SHORT, (a != b).sum(1) <= 2 * ((1 - similarity) * most + 1e-9).astype(np.int64), bags_allow(a, b, similarity))


def short_grams(u: np.ndarray, n: int) -> np.ndarray:
    """Keys of a text of n words: two texts of up to SHORT words and at least SIMILARITY share one.

    An edit changes K k-mers at most, so similar texts share a number of labelled k-mers; all but so many, less one, of
    each text's least hashes must then have one in common.
    """
    if not K <= n <= SHORT:
        return np.zeros(0, np.int64)
    shared = min(m - K + 1 - K * int((1 - SIMILARITY) * m + 1e-9) for m in range(n, int(n / SIMILARITY + 1e-9) + 1))
    least = np.sort(u)[: len(u) - max(1, shared) + 1]
    return ((least >> np.uint64(2)) | np.uint64(1 << 62)).view(np.int64)


def order_sketch(g: np.ndarray, u: np.ndarray) -> np.ndarray:
    """SKETCHES hashes (int32) of one document's L least k-mers in text order."""
    n = len(u)
    if n <= L:
        at = np.broadcast_to(np.arange(n), (SKETCHES, n))
    else:
        at = np.empty((SKETCHES, L), np.int64)
        step = max(1, min(SKETCHES, 4_000_000 // n))
        for i in range(0, SKETCHES, step):
            p = _MULT[i : i + step, None] * u[None, :]
            row = np.arange(len(p))
            for k in range(L):  # the least, L times
                at[i : i + step, k] = p.argmin(1)
                p[row, at[i : i + step, k]] = np.iinfo(np.uint64).max
    v = g[np.sort(at, axis=1)]
    acc = np.arange(SKETCHES, dtype=np.uint64)
    for i in range(v.shape[1]):
        acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + v[:, i])
    return (acc >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        data, off = buffers(b.column(1))
        for i, j in chunks(off):
            h, w = word_hashes(data, off[i : j + 1])
            n = np.diff(w)
            g, u, o = labelled_kmers(h, w)
            use = np.flatnonzero(n > 0)
            sk = [order_sketch(g[o[r] : o[r + 1]], u[o[r] : o[r + 1]]) for r in use]
            dig = [xxhash.xxh3_128_digest(h[w[r] : w[r + 1]].tobytes()) for r in use]
            bags = bag_sketch(h, w)[use]
            grams = [short_grams(u[o[r] : o[r + 1]], int(n[r])) for r in use]
            flat = pa.array(np.concatenate(sk) if sk else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sk) + 1, dtype=np.int32) * SKETCHES), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][use].astype(np.int64)), pa.array(n[use].astype(np.int32)), pa.array(dig, pa.binary()), lists, pa.array([x.tobytes() for x in bags], pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sk", "bag", "grams"])


def _likely(a: int, rest: np.ndarray, n: np.ndarray, bag: np.ndarray, similarity: float) -> np.ndarray:
    """Those of ``rest`` whose length and bag of words allow the similarity to ``a``."""
    rest = rest[np.minimum(n[rest], n[a]) >= similarity * np.maximum(n[rest], n[a])]
    return rest[pair_allowed(n[a], n[rest], bag[rest], bag[a][None, :], similarity)]


def leader_pairs(bucket: np.ndarray, ids: np.ndarray, n: np.ndarray, bag: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(places of candidates, a row a pair; places of leaders) of blocks that lie one after the other, ids ascending in each.

    All blocks lose their next leader at once, with the members that leave with it.
    """
    pairs, leaders = [], []
    pool = np.arange(len(ids))
    while len(pool):
        new = np.ones(len(pool), bool)
        new[1:] = bucket[pool[1:]] != bucket[pool[:-1]]
        own = pool[new]
        leader = np.repeat(own, np.diff(np.append(np.flatnonzero(new), len(pool))))
        leaders.append(own)
        rest, lead = pool[~new], leader[~new]
        near = np.minimum(n[rest], n[lead]) >= similarity * np.maximum(n[rest], n[lead])
        at = np.flatnonzero(near)
        near[at] = pair_allowed(n[lead[at]], n[rest[at]], bag[lead[at]], bag[rest[at]], similarity)
        pairs.append(np.stack([lead[near], rest[near]], 1))
        pool = rest[~near]
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), np.concatenate(leaders) if leaders else np.zeros(0, np.int64)


def open_pairs(ids: np.ndarray, n: np.ndarray, bag: np.ndarray, group: np.ndarray, role: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Candidates between the strays (role 1, 2) and the members (0, 2) of two blocks that aren't in one group."""
    out = []
    members = np.flatnonzero(role != 1)
    for a in np.flatnonzero(role > 0):
        rest = members[group[members] != group[a]]
        if role[a] == 2:
            rest = rest[(role[rest] == 0) | (ids[rest] > ids[a])]
        out += [(int(min(ids[a], x)), int(max(ids[a], x))) for x in ids[_likely(a, rest, n, bag, similarity)]]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(number of the block, columns but the last, bags) of whole blocks, runs of rows that are equal in the first ``keys`` columns; the bag is the last column."""
    held: list = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if b.num_rows:
                held.append((*(b.column(c).to_numpy(zero_copy_only=False) for c in range(b.num_columns - 1)), np.frombuffer(b"".join(x.as_buffer() for x in b.column(b.num_columns - 1)), np.uint8).reshape(-1, BAG)))
            if not held or (len(held) > 1 and all((c[0] == d[-1]) for c, d in zip(held[0][:keys], held[-1][:keys], strict=True))):
                continue  # a block that goes on
        if not held:
            return
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        end = len(new) if b is None else last
        held = [] if b is None else [tuple(c[last:] for c in cols)]
        if end:
            yield np.cumsum(new[:end]), *(c[:end] for c in cols)


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, block, many, doc_id, n, bag -> a, b; of buckets of many blocks also the leaders: key, a and null."""
    for block, key, _, many, ids, n, bag in _blocks(batches, 3):
        pairs, leaders = leader_pairs(block, ids, n, bag)
        pairs, leaders = pairs[ids[pairs[:, 0]] != ids[pairs[:, 1]]], leaders[many[leaders]]
        at = np.concatenate((pairs[:, 0], leaders))
        if len(at):
            b = pa.concat_arrays([pa.array(ids[pairs[:, 1]]), pa.nulls(len(leaders), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ids[at]), b], ["key", "a", "b"])


def _strays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, stray block, member block, doc_id, n, group, role, bag -> a, b."""
    for block, _, _, _, ids, n, group, role, bag in _blocks(batches, 3):
        bounds = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
        pairs = [p for i, j in zip(bounds[:-1], bounds[1:], strict=True) for p in open_pairs(*(c[i:j] for c in (ids, n, bag, group, role)))]
        if pairs:
            x = np.array(pairs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def word_masks(a: list[int]) -> dict[int, int]:
    """Bit i of a word's mask: the word is at place i."""
    at: dict[int, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    out, marks = {}, np.zeros(len(a), bool)
    for w, places in at.items():
        if len(places) < 12:
            x = 0
            for i in places:
                x |= 1 << i
        else:
            marks[places] = True
            x = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
            marks[places] = False
        out[w] = x
    return out


def _band(masks: dict[int, int], skip: int, n: int, b: list[int], t: int) -> int:
    """Edit distance of b and the n words from ``skip`` on whose masks are given, if at most t, else more than t.

    Column by column over b; the band's 2t + 1 rows are bits: vertical steps up (vp) and down (vn). The lowest diagonal is followed
    to the last row, then that row to its end.
    """
    m = len(b)
    full = (1 << 2 * t + 1) - 1
    vp, vn, dist, last = full ^ ((1 << t) - 1), 0, min(n, t), 2 * t
    turn = max(0, n - t)
    worst = t + m - turn
    get = masks.get
    shift = -t
    for c in b[:turn]:
        x = get(c)
        if x is None:
            d = vn
        else:
            x = (x >> skip + shift if shift >= 0 else x >> skip << -shift) & full
            d = ((((x & vp) + vp) ^ vp) | x | vn) & full
        shift += 1
        up, down = vn | ((d | vp) ^ full), d & vp
        if not d >> last:
            dist += 1
            if dist > worst:
                return t + 1
        d >>= 1
        vp, vn = down | ((d | up) ^ full), d & up
    row = n - turn - 1 + t
    for c in b[turn:]:
        x = get(c, 0)
        x = (x >> skip + shift if shift >= 0 else x >> skip << -shift) & full
        shift += 1
        d = ((((x & vp) + vp) ^ vp) | x | vn) & full
        up, down = vn | ((d | vp) ^ full), d & vp
        dist += (up >> row & 1) - (down >> row & 1)
        row -= 1
        d >>= 1
        vp, vn = down | ((d | up) ^ full), d & up
    return dist


def edit_within(a: np.ndarray, b: np.ndarray, limit: int, masks: dict[int, int] | None = None) -> int:
    """Edit distance of two arrays if at most ``limit``, else limit + 1. ``masks`` are those of the whole of ``a``."""
    if abs(len(b) - len(a)) > limit:
        return limit + 1
    short = min(len(a), len(b))
    p = int(np.argmin(np.append(a[:short] == b[:short], False)))
    s = int(np.argmin(np.append((a[len(a) - short + p :] == b[len(b) - short + p :])[::-1], False))) if p < short else 0
    n, m = len(a) - p - s, len(b) - p - s
    if not n or not m:
        return n + m if n + m <= limit else limit + 1
    masks = word_masks(a.tolist()) if masks is None else masks
    middle = b[p : len(b) - s].tolist()
    t = max(48, abs(n - m), n // 12)
    while True:
        t = min(t, limit)
        d = _band(masks, p, n, middle, t)
        if d <= t:
            return d
        if t == limit:
            return limit + 1
        t *= 4


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, part, b, words, sorted; b is null where the words are a's own -> a, b, similarity of the edges."""
    own, left, masks = None, [], []
    for batch in batches:
        out: list[tuple[int, int, float]] = []
        for a, part, b, w in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
            w = np.frombuffer(w.as_buffer(), np.uint32)
            if (a, part) != own:
                own, left, masks = (a, part), [], []
            if b is None:  # rows that share a doc_id are texts of one document
                left.append(w)
                masks.append(None)
                continue
            best = 0.0
            for k, x in enumerate(left):
                n = max(len(x), len(w))
                limit = int((1 - SIMILARITY) * n + 1e-9)
                if min(len(x), len(w)) < n - limit:
                    continue
                masks[k] = word_masks(x.tolist()) if masks[k] is None else masks[k]
                d = edit_within(x, w, limit, masks[k])
                if d <= limit:
                    best = max(best, 1 - d / n)
            if best >= SIMILARITY - 1e-12:
                out.append((a, b, best))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])


def _word_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b.column(1))
        for i, j in chunks(off):
            h, w = word_hashes(data, off[i : j + 1])
            h = (h >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([h[x:y].tobytes() for x, y in zip(w[:-1], w[1:], strict=True)], pa.binary())], ["doc_id", "words"])


def components(edges: DataFrame) -> DataFrame:
    """Edges a, b -> node, group (least node of its component), for all nodes with an edge."""
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        w = Window.partitionBy("u")
        big = both.withColumn("m", F.least("u", F.min("v").over(w))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = Window.partitionBy("u")
        small = big.withColumn("m", F.min("v").over(down))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e, old = durable(small, "cc"), e
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("group"))
        before = now


def _verified(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """The pairs a, b (durable) whose texts in ``x`` align: a, b, similarity."""
    many = pairs.groupBy(F.col("a").alias("m_")).agg(F.ceil(F.count("*") / F.lit(LED)).alias("parts"))
    parted = pairs.join(many, F.col("a") == F.col("m_")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    wanted = parted.select(F.col("b").alias("id_"), "a", "part", "b").union(parted.select(F.col("a").alias("id_"), "a", "part", F.lit(None).cast("long").alias("b")).distinct())
    texts = x.mapInArrow(_word_bytes, "doc_id long, words binary").where("length(words) > 0")
    sent = texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("id_")).select("a", "part", "b", "words")
    aligned = sent.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(_align, "a long, b long, similarity double")
    return aligned.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _blocked(members: DataFrame, salt: int) -> DataFrame:
    """members: key, d_ -> also block and whether its bucket has many."""
    sizes = members.groupBy(F.col("key").alias("k_")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).where("blocks > 1")
    x = members.join(sizes, F.col("key") == F.col("k_"), "left")
    return x.select("key", F.coalesce(F.pmod(F.xxhash64("d_", F.lit(salt)), F.col("blocks")), F.lit(0)).cast("long").alias("block"), F.col("k_").isNotNull().alias("many"), "d_")


def led_pairs(met: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidates a, b (durable) of the leaders of the buckets met: key, d_."""
    found, members, n, salt = None, met, None, 0
    while True:
        full = _blocked(members, salt).join(reps, F.col("d_") == F.col("doc_id")).select("key", "block", "many", "doc_id", "n", "bag")
        out = durable(full.repartition("key", "block").sortWithinPartitions("key", "block", "doc_id").mapInArrow(_lead, "key long, a long, b long"), "dedup-led")
        pairs = out.where("b is not null").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        leaders = out.where("b is null").select("key", F.col("a").alias("d_")).distinct()
        left = leaders.count()
        # blocks of texts that aren't alike have as many leaders as members: strays_pairs compares them
        if not left or (n is not None and 2 * left > n) or leaders.groupBy("key").count().where(F.col("count") > 1).isEmpty():
            return durable(found.distinct(), "dedup-pairs")
        members, n, salt = leaders, left, salt + 1


def stray_pairs(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidates a, b between the strays of a bucket and all its members: key, d_, group."""
    sizes = members.groupBy("key", "group").agg(F.count("*").alias("c")).groupBy(F.col("key").alias("k_")).agg(F.sum("c").alias("all"), F.max(F.struct("c", "group")).alias("most"))
    sizes = sizes.where(F.col("all") > F.col("most.c")).select("k_", F.col("most.group").alias("main"), F.ceil(F.col("all") / BLOCK).alias("of"), F.ceil((F.col("all") - F.col("most.c")) / BLOCK).alias("odd"))
    x = members.join(sizes, F.col("key") == F.col("k_")).withColumn("stray", F.col("group") != F.col("main"))
    one = F.col("of") == 1
    block, own = F.pmod(F.xxhash64("d_"), F.col("of")), F.pmod(F.xxhash64("d_", F.lit(1)), F.col("odd"))
    zero = F.lit(0).cast("long")
    as_member = F.transform(F.sequence(zero, F.col("odd") - 1), lambda i: F.struct(i.alias("s"), block.alias("i"), F.when(one & F.col("stray"), 2).otherwise(0).alias("role")))
    as_stray = F.when(F.col("stray") & ~one, F.transform(F.sequence(zero, F.col("of") - 1), lambda i: F.struct(own.alias("s"), i.alias("i"), F.lit(1).alias("role")))).otherwise(F.array())
    rows = x.select("key", "d_", "group", F.explode(F.concat(as_member, as_stray)).alias("r")).select("key", "d_", "group", "r.*")
    full = rows.join(reps, F.col("d_") == F.col("doc_id")).select("key", "s", "i", "doc_id", "n", "group", "role", "bag")
    return full.repartition("key", "s", "i").sortWithinPartitions("key", "s", "i", "doc_id").mapInArrow(_strays, "a long, b long").where("a <> b").distinct()


def near_edges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of all documents with words; verified edges a, b, similarity between first copies)."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = durable(x.mapInArrow(_sign, "doc_id long, n int, digest binary, sk array<int>, bag binary, grams array<bigint>"), "dedup-signed")
    first = durable(signed.groupBy("digest").agg(F.min("doc_id").alias("rep")), "dedup-first")
    reps = signed.join(first.select(F.col("digest").alias("g_"), "rep"), (F.col("digest") == F.col("g_")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["doc_id", "digest"]).select("doc_id", "n", "sk", "bag", "grams")
    reps = durable(reps, "dedup-reps")
    rows = reps.select("doc_id", F.posexplode("sk").alias("band", "v")).select("doc_id", F.expr("shiftleft(cast(band as bigint), 32) | (cast(v as bigint) & 4294967295)").alias("key"))
    rows = rows.union(reps.select("doc_id", F.explode("grams").alias("key")))
    shared = rows.groupBy(F.col("key").alias("k_")).agg(F.count("*").alias("c")).where("c > 1").select("k_")
    met = durable(rows.join(shared, F.col("key") == F.col("k_")).select(F.col("doc_id").alias("d_"), "key").distinct(), "dedup-buckets")
    reps = reps.select("doc_id", "n", "bag")
    led = led_pairs(met, reps)
    edges = durable(_verified(led, x), "dedup-edges")
    joined = components(edges).select(F.col("node").alias("n_"), "group")
    members = met.join(joined, F.col("d_") == F.col("n_"), "left").select("key", "d_", F.coalesce("group", "d_").alias("group"))
    late = stray_pairs(members, reps).join(led.select(F.col("a").alias("a_"), F.col("b").alias("b_")), (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "left_anti")
    edges = edges.union(_verified(durable(late, "dedup-pairs"), x))
    copies = signed.join(first.select(F.col("digest").alias("g_"), "rep"), F.col("digest") == F.col("g_")).select("doc_id", "rep")
    return durable(copies, "dedup-copies"), durable(edges, "dedup-edges")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id of those in a group of two or more but for its least doc_id (durable)."""
    copies, edges = near_edges(docs)
    exact = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    return durable(components(edges.select("a", "b").union(exact)).select(F.col("node").alias("doc_id"), F.col("group").alias("group_id")), "dedup-groups")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of least doc_id. All columns pass through."""
    dropped, again_, n_ = fresh(docs, "__dropped", "__again", "__n")
    drop = groups(docs).where("doc_id <> group_id").select(F.col("doc_id").alias(dropped))
    x = docs.join(drop, F.col("doc_id").cast("long") == F.col(dropped), "left_anti")
    has_words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[\\p{L}\\p{N}]")) > 0, F.lit(False))
    again = durable(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(again_)), "dedup-again")
    if not again.count():
        return x
    hit = F.col("doc_id") == F.col(again_)
    once = x.join(again, hit, "left_anti")
    more = x.join(again, hit, "left_semi")
    first = more.where(has_words).withColumn(n_, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where(F.col(n_) == 1).drop(n_)
    return once.unionByName(first).unionByName(more.where(~has_words))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, group_id (least doc_id of the group, else its own), kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    g = groups(docs).select(F.col("doc_id").alias("d_"), "group_id")
    out = docs.select("doc_id").join(g, F.col("doc_id") == F.col("d_"), "left")
    group = F.coalesce("group_id", "doc_id")
    return out.select("doc_id", group.alias("group_id"), group.eqNullSafe(F.col("doc_id")).alias("kept"))
