import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sectionwise.llm import cdx, chat, gif, mixing, packing, quality, tokenbin

DOCS = "doc_id long, text string, lang string, source string, n_chars long, D_ string"


def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, None, None, None, None, None), (None, "", None, None, None, None)], DOCS)


def words(rng, n):
    return [f"w{rng.integers(0, 500)}" for _ in range(n)]


def test_gif_round_trip_and_composition():
    rng = np.random.default_rng(1)
    pal = rng.integers(0, 256, (16, 3))
    a, b = rng.integers(0, 16, (9, 11)), rng.integers(0, 16, (4, 5))
    data = gif.encode(11, 9, pal, [{"pixels": a, "delay": 5, "interlaced": True}, {"pixels": b, "left": 2, "top": 3, "clear": 7, "delay": 7, "disposal": 3}, {"pixels": b[:1, :1], "disposal": 2}])
    f = gif.decode(data)
    first = pal[a]
    second = first.copy()
    second[3:7, 2:7][b != 7] = pal[b[b != 7]]
    third = first.copy()
    third[0, 0] = pal[b[0, 0]]
    for x, want in zip(f, (first, second, third), strict=True):
        assert (np.frombuffer(x["rgba"], np.uint8).reshape(9, 11, 4)[:, :, :3] == want).all()
        assert sum(x["histogram"]) == 99
    assert [x["start_cs"] for x in f] == [0, 5, 12]
    for k in range(len(data)):  # whatever is cut off, nothing raises
        assert gif.decode(data[:k])[-1]["error"]


@pytest.mark.parametrize("n", [0, 1, 400, 60_113, 200_000])
def test_page_gif_draws_every_byte(n):
    html = np.random.default_rng(n).integers(32, 127, n).astype(np.uint8).tobytes()
    f = gif.decode(gif.page_gif(html, 5))
    assert not any(x["error"] for x in f)
    red = b"".join(x["rgba"][::4] for x in f)
    assert len(red) >= n and red.startswith(html)


def test_lzw_deferred_clear():
    px = np.random.default_rng(3).integers(0, 4, 60_000).astype(np.uint8)
    codes, table, w = [], {bytes([i]): i for i in range(4)}, b""
    for c in px.tobytes():
        c = bytes([c])
        if w + c in table:
            w += c
            continue
        codes.append(table[w])
        if len(table) + 2 < 4096:
            table[w + c] = len(table) + 2
        w = c
    codes.append(table[w])
    acc, at = 4, 3
    for i, c in enumerate(codes):
        width = max(3, min(12, (6 + i - 1).bit_length())) if i else 3
        acc |= c << at
        at += width
    got, error = gif.lzw(acc.to_bytes(at // 8 + 1, "little"), 2, len(px))
    assert error is None and (got == px).all()


def slow_gif(b):
    """(time, canvas as rows of RGBA tuples) of each frame of a sound file: one code, one pixel at a time."""
    word = lambda i: b[i] | b[i + 1] << 8

    def colours(i, packed):
        n = 2 << (packed & 7) if packed & 128 else 0
        return [tuple(b[i + 3 * k : i + 3 * k + 3]) for k in range(n)], i + 3 * n

    w, h = word(6), word(8)
    shared, i = colours(13, b[10])
    canvas = [[(0, 0, 0, 0)] * w for _ in range(h)]
    out, clock, disposal, delay, clear = [], 0, 0, 0, None
    while b[i] != 0x3B:
        if b[i] == 0x21:
            label, data, i = b[i + 1], b"", i + 2
            while b[i]:
                data += b[i + 1 : i + 1 + b[i]]
                i += 1 + b[i]
            i += 1
            if label == 0xF9:
                disposal, delay, clear = data[0] >> 2 & 7, data[1] | data[2] << 8, data[3] if data[0] & 1 else None
            continue
        x0, y0, fw, fh, packed = word(i + 1), word(i + 3), word(i + 5), word(i + 7), b[i + 9]
        own, i = colours(i + 10, packed)
        size, data, i = b[i], b"", i + 1
        while b[i]:
            data += b[i + 1 : i + 1 + b[i]]
            i += 1 + b[i]
        i += 1
        bits, px, width, at = int.from_bytes(data, "little"), [], size + 1, 0
        table, last = [], None
        while True:
            code = bits >> at & ((1 << width) - 1)
            at += width
            if code == 1 << size:
                table, last, width = [bytes([k]) for k in range(1 << size)] + [b"", b""], None, size + 1
                continue
            if code == (1 << size) + 1:
                break
            said = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + said[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            px += said
            last = said
        rows = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, fh, d)] if packed & 64 else range(fh)
        before = [list(r) for r in canvas]
        for k, r in enumerate(rows):
            for c in range(fw):
                v = px[k * fw + c]
                if v != clear and y0 + r < h and x0 + c < w:
                    canvas[y0 + r][x0 + c] = (*(own or shared)[v], 255)
        out.append((clock, [list(r) for r in canvas]))
        clock += delay
        if disposal == 2:
            for r in range(y0, min(y0 + fh, h)):
                for c in range(x0, min(x0 + fw, w)):
                    canvas[r][c] = (0, 0, 0, 0)
        elif disposal == 3:
            canvas = before
        disposal, delay, clear = 0, 0, None
    return out


def test_gif_frames_of_pages_against_plain_loops(spark):
    """op1's rows on sf0.001, and on files of random frames that reach over the canvas."""
    rng = np.random.default_rng(5)
    rows = {r["page_id"]: r["gif"] for r in gif.page_gifs(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for k in range(40):
        pal = rng.integers(0, 256, (int(rng.integers(2, 33)), 3))
        images = [{"pixels": rng.integers(0, len(pal), (int(rng.integers(1, 12)), int(rng.integers(1, 12)))), "left": int(rng.integers(0, 9)), "top": int(rng.integers(0, 9)), "delay": int(rng.integers(0, 9)), "disposal": int(rng.integers(0, 4)), "clear": int(rng.integers(0, len(pal))) if rng.random() < 0.5 else None, "interlaced": bool(rng.random() < 0.5), "palette": pal[::-1] if rng.random() < 0.3 else None} for _ in range(5)]
        rows[-1 - k] = gif.encode(10, 9, pal, images)
    d = spark.createDataFrame(list(rows.items()), "page_id long, gif binary")
    got = {}
    for r in gif.frames(d, "page_id", "gif").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == set(rows)
    for i, b in rows.items():
        want = slow_gif(bytes(b))
        for r, (clock, canvas) in zip(sorted(got[i], key=lambda r: r["frame"]), want, strict=True):
            flat = [p for row in canvas for p in row]
            assert r["error"] is None and r["start_cs"] == clock and r["n_frames"] == len(want)
            assert bytes(r["rgba"]) == bytes(v for p in flat for v in p)
            seen = [(p[0] >> 6) * 16 + (p[1] >> 6) * 4 + (p[2] >> 6) for p in flat if p[3]]
            assert r["visible"] == len(seen) and r["histogram"] == [seen.count(k) for k in range(64)]


def test_gif_frames_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, b"junk", "y"), (None, b"junk", "y")], "id long, gif binary, frame string")
    assert sorted(r["error"] for r in gif.frames(df, "id", "gif").collect()) == ["empty", "header", "header"]
    assert gif.frames(df.limit(0), "id", "gif").count() == 0


def test_gif_frames_come_one_by_one():
    px = np.zeros((300, 300), np.uint8)
    data = gif.encode(300, 300, np.zeros((2, 3)), [{"pixels": px}] * 60)
    stream = gif.decode_frames(data)
    assert next(stream)["n_frames"] == 60 and sum(1 for _ in stream) == 59


def test_chat_visitor():
    v = chat.Visitor()
    v.message(0, "user", '[{"type":"text","text":"a <|x b"},{"type":"document","uri":"d","parts":[{"type":"image","width":29,"height":28},{"type":"document","parts":[]},3]},{"type":"audio","ms":41}]')
    assert "".join(v.out) == "<|start|>user\na <\\|x b<|document:1|><|image:2|><|document:3|><|/document|><|unknown:4|><|/document|><|audio:5|><|end|>\n"
    assert [r["tokens"] for r in v.refs] == [2, 4, 2, 0, 4] and v.words == 3
    for odd in (None, "", "[", "[1", '{"a":1}', "[" * 5000, '["a', "[1e999]"):
        chat.Visitor().message(None, None, odd)


def test_chat_bad_rows(spark):
    messages = [
        (1, 0, "user", '[{"type":"text","text":"x \\ud83d y"},{"type":"image","uri":"\\ud83d","width":9e14,"height":9e14},{"type":"image","width":1e999,"height":NaN}]'),
        (1, 0, "user", '[{"type":"audio","ms":1e999},{"type":"audio","ms":-3},{"type":"image","width":true,"height":"9"}]'),
        (None, None, None, None), (None, None, None, "b"), (None, None, None, "b"), (None, 1, "r", ""),
        (3, 5, "user", "long " * 400_000),
    ]
    d = spark.createDataFrame(messages, "conv_id long, turn long, role string, content string").withColumn("t", F.lit(7)).withColumn("text", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.flatten(d).collect()}
    assert len(got) == 3 and "x \ufffd y<|image:4|>" in got[1]["text"]
    assert got[1]["media_tokens"] == sum(a["tokens"] for a in got[1]["attachments"]) == chat.MOST
    assert got[1]["attachments"][3]["uri"] == "\ufffd"
    assert got[None]["n_turns"] == 4 and got[None]["text"].count("b<|end|>") == 2
    assert got[3]["text_tokens"] == 400_000
    assert chat.flatten(d.limit(0)).count() == 0


def test_capture_index(spark):
    urls = ["http://www.a.com/x", "https://a.com:443/x#f", "a.com", "http://b.a.com:81/?q=1", None, "", "http://a.com/y\t"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}", "k") for i, u in enumerate(urls)] + [(None, "http://z.org/", None, "k")], "page_id long, url string, html string, key string")
    folder, directory = cdx.build(pages, block=2, parts=2)
    q = spark.createDataFrame([(0, "http://a.com/x"), (0, "http://a.com/x"), (1, "http://none.org/"), (2, "http://b.a.com:81/?q=1"), (3, "z.org"), (4, None), (None, "a.com")], "query_id long, url string")
    rows = cdx.lookup(folder, directory, q).collect()
    got = {r["query_id"]: (r["captures"], r["page_id"], r["html_bytes"]) for r in rows}
    assert len(rows) == 7 and got == {0: (2, 1, 4), 1: (0, None, None), 2: (1, 3, 4), 3: (1, None, 0), 4: (2, 5, 4), None: (1, 2, 4)}
    assert sorted(r["page_id"] for r in cdx.captures(folder, directory, q).where("page_id < 2").collect()) == [0, 1]
    folder, directory = cdx.build(pages.limit(0))
    assert {r["captures"] for r in cdx.lookup(folder, directory, q).collect()} == {0} and not cdx.captures(folder, directory, q).count()


def test_a_hot_key_spreads_over_index_files(spark):
    pages = spark.range(600).selectExpr("id as page_id", "if(id % 3 = 0, null, concat('http://h', id % 7, '.org/', id)) as url", "concat('<p>', id) as html")
    folder, directory = cdx.build(pages, block=10, parts=6)
    hot = directory.where("first_key = '-'").select("part").distinct().count()
    got = cdx.lookup(folder, directory, pages.selectExpr("page_id as query_id", "url")).collect()
    assert hot > 1 and len(got) == 600
    assert all((r["captures"], r["page_id"]) == ((200, 597) if r["query_id"] % 3 == 0 else (1, r["query_id"])) for r in got)
    assert sorted(r["page_id"] for r in cdx.captures(folder, directory, pages).collect()) == list(range(600))


def read_part(root, name):
    off = np.fromfile(f"{root}/{name}.off", "<i8")
    return off, np.fromfile(f"{root}/{name}.bin", "<u2")


@pytest.mark.parametrize("parts", [1, 5])
def test_token_files_against_the_encoder(spark, parts):
    """Every document's ids are the tokenizer's own; each part's files and the offsets of the whole fit together."""
    import os

    texts = ["Hello world", "", None, "naïve 漢字 \U0001f600  x\n", "Hello world", "it's 3.14\t\r\n ", "word " * 200_000]
    d = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("part", F.lit(3)).withColumn("row", F.lit(4)).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "0 as part", "0 as row")).repartition(parts)
    texts = {r["doc_id"]: r["text"] for r in d.collect() if r["doc_id"] is not None} | {None: "Hello world"}
    folder, placed = tokenbin.tokenise(d)
    enc = tokenbin.Encoder(tokenbin.VOCABULARY).core
    rows = sorted(placed.collect(), key=lambda r: (r["part"], r["row"]))
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(texts)
    at = 0
    for r in rows:
        assert r["offset"] == at and r["n_tokens"] == len(enc.encode_ordinary(texts[r["doc_id"]] or ""))
        at += r["n_tokens"]
    root = folder.removeprefix("file://")
    names = sorted(x[:-4] for x in os.listdir(root) if x.endswith(".off"))
    assert len(names) == len({r["part"] for r in rows}) and {x.rpartition(".")[2] for x in os.listdir(root)} <= {"off", "bin", "crc"}
    k = 0
    for name in names:
        off, ids = read_part(root, name)
        assert off[0] == rows[k]["offset"] and off[-1] - off[0] == len(ids)
        for a, b in zip(off[:-1], off[1:], strict=True):
            assert ids[a - off[0] : b - off[0]].tolist() == enc.encode_ordinary(texts[rows[k]["doc_id"]] or "")
            k += 1
    m = tokenbin.Mapped(folder)
    assert len(m) == len(rows) == k and all(m[i].tolist() == enc.encode_ordinary(texts[r["doc_id"]] or "") for i, r in enumerate(rows))


def test_token_files_of_an_empty_table(spark):
    folder, placed = tokenbin.tokenise(spark.createDataFrame([], "doc_id long, text string"))
    assert placed.count() == 0


def test_hilbert_neighbours():
    n = 8
    cells = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def slow_pack(rows, capacity):
    """pack's rows from (doc_id, text): vectors by plain sums, one list, one cursor."""
    import math

    from sectionwise.llm.wordhash import buffers, mix64, word_hashes

    keyed = []
    for i, t in rows:
        h, _ = word_hashes(*buffers(pa.array([t or ""])))
        if not len(h):
            continue
        cell = []
        for d in range(packing.DIMS):
            total = sum((int(v) >> 21 * d & 0x1FFFFF) - 0x100000 for v in mix64(h))
            cell.append(min((1 << packing.BITS) - 1, max(0, math.floor((1 << packing.BITS) / (1 + math.exp(-packing.SHARPNESS * (total / len(h) / 0x100000)))))))
        keyed.append((int(packing.hilbert(np.array([cell]))[0]), i is not None, i, len(h) + 1))
    out, at = [], 0
    for key, _, i, n in sorted(keyed, key=lambda x: (x[0], x[1], x[2] or 0, x[3])):
        done = 0
        while done < n:
            take = min(n - done, capacity - at % capacity)
            out.append((at // capacity, at % capacity, i, done, take, key))
            at, done = at + take, done + take
    return sorted(out, key=repr)


def test_packing_against_one_list(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "a b c"), (9001, ""), (9002, None), (9003, "..."), (9004, "same text"), (9005, "same text"), (9005, "same text"), (9006, "w " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(1), "tokens": F.lit(2), "at": F.lit(3), "upto": F.lit(4)}).repartition(7)
    for capacity in (8, 2048):
        got = sorted((tuple(r) for r in packing.pack(d, capacity).collect()), key=repr)
        assert got == slow_pack(rows, capacity)
    assert packing.pack(d.limit(0)).count() == 0


def test_packed_neighbours_are_alike(spark):
    """Documents of a topic lie next to each other far more often than by chance."""
    rng = np.random.default_rng(17)
    topic = rng.integers(0, 8, 600)
    texts = [" ".join([f"t{t}w{rng.integers(0, 30)}" if rng.random() < 0.6 else f"c{rng.integers(0, 300)}" for _ in range(300)]) for t in topic]
    got = packing.keys(docs(spark, texts)).orderBy("hilbert", "doc_id").collect()
    order = topic[[r["doc_id"] for r in got]]
    assert (order[1:] == order[:-1]).mean() > 0.6  # by chance an eighth


def slow_metrics(text):
    """METRICS of one text, character by character."""
    kind = lambda c: unicodedata.category(c)
    ws = [w for w in re.split("[ \\n\\t\\r]+", text or "") if w]
    if not ws:
        return None
    lines = [x for x in text.split("\n") if x]
    named = lambda c: kind(c)[0] in "LN"
    odd = sum(not named(c) and c not in " \n\t\r" for c in text)
    return {
        "symbols": odd * 10_000 // len(text),
        "capitals": sum(kind(c) == "Lu" for c in text) * 10_000 // len(text),
        "word_len": sum(map(len, ws)) * 100 // len(ws),
        "repeated_words": sum(a == b for a, b in zip(ws[1:], ws, strict=False)) * 10_000 // len(ws),
        "repeated_lines": (len(lines) - len(set(lines))) * 10_000 // max(1, len(lines)),
        "bars": sum(not any(map(named, w)) for w in ws) * 10_000 // len(ws),
    }


def test_quality_metrics_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    bits = ["a", "B", " ", " ", "\n", "\t", "\r", "é", "É", "漢", "Ж", "１", "½", "\U0001f600", "\U00010400", "|", "-", "\u00a0", "\0", "the ", "the\n"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 60))) for _ in range(400)] + [None, "", " \n", "word " * 300_000, "é", "a\na\na", "| | | a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).select("doc_id", quality.metrics(F.col("text")).alias("m")).collect()
    got = {r["doc_id"]: r["m"] and r["m"].asDict() for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == slow_metrics(t), t


def test_quality_edges(spark):
    d = docs(spark, ["plain words in a row here"] * 60 + ["%%% ### $$$ " * 30, "", None])
    kept = [r["doc_id"] for r in quality.accept(d).collect()]
    assert sorted(kept) == list(range(60)) and quality.accept(d).columns == d.columns
    assert quality.accept(d.limit(0)).count() == 0


def test_quality_keeps_values_on_a_fence_and_odd_groups(spark):
    rows = [(1, "one two three", None, None), (1, "one two three", None, None), (None, "one two three", "de", None)] + [(i, "one two three", "en", "s") for i in range(2, 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("__m", F.lit(1)).withColumn("__l", F.lit(2)).withColumn("__q", F.lit(3))
    assert quality.accept(d).count() == len(rows) and quality.accept(d).columns == d.columns
    # a fence is 4 spreads of 300 above 0: one symbol in 8.33 characters
    base = [(i, "abcdefghij klmnopqrst", "en", "s") for i in range(200)]
    at, over = "a" * 22 + "!" * 3, "a" * 21 + "!" * 3
    d = spark.createDataFrame([*base, (1000, at, "en", "s"), (1001, over, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["q"] for r in quality.judge(d, "q").where("doc_id >= 1000").collect()}
    assert got[1000]["symbols"] == 1200 and "symbols" not in got[1000]["reasons"] and "symbols" in got[1001]["reasons"]


def test_quality_thresholds_change_smoothly(spark):
    """One document more never moves a group's fence by more than its share of the distance to its neighbours."""
    rows = lambda n: [(0, 0, 500, 0, 0, 0, "en", "big")] * 1000 + [(2000, 0, 500, 0, 0, 0, "en", "own")] * n
    fences = []
    for n in (1, 38, 39, 40, 41, 400):
        x = spark.createDataFrame(rows(n), ", ".join(f"{m} long" for m in quality.METRICS) + ", lang string, source string")
        fences.append(quality.thresholds(x).where("source = 'own'").first()["hi_symbols"])
    assert fences == sorted(fences) and max(b - a for a, b in zip(fences[1:4], fences[2:5], strict=True)) < 40


def slow_budget(node, budget, weights, epochs):
    """Shares of a tree {name: subtree or tokens}: pour by weight, take back what is over, until nothing is."""
    supply = lambda x: sum(map(supply, x.values())) if isinstance(x, dict) else x * epochs
    caps, out, left, free = {k: supply(v) for k, v in node.items()}, {}, budget, dict(node)
    while free:
        total = sum(weights(k) for k in free)
        full = [k for k in free if caps[k] * total <= left * weights(k)]
        if not full:
            out |= {k: left * weights(k) // total for k in free}
            break
        for k in full:
            out[k] = caps[k]
            del free[k]
        left = budget - sum(out.values())
    return out


@pytest.mark.parametrize("budget", [0, 1, 100, 1_500, 3_000, 100_000])
def test_budgets_against_a_plain_tree(spark, budget):
    """Shortages go to siblings before ancestors, whatever the tree."""
    tree = mixing.Tree({"d1": ["a", "b", "c"], "d2": ["e"]}, {"d1": 5, "d2": 3}, {"en": 7, "de": 2}, {"a": 4}, other=1, other_source=2)
    tokens = {("d1", "en", "a"): 300, ("d1", "en", "b"): 20, ("d1", "en", "c"): 400, ("d1", "de", "a"): 7, ("d2", "en", "e"): 150, ("d2", None, "e"): 30, ("other", "en", None): 250, ("other", "de", "zz"): 11}
    rows = [(i, " ".join(["w"] * n), la, so) for i, ((_, la, so), n) in enumerate(tokens.items())]
    d = spark.createDataFrame(rows + [(99, "", "en", "a"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    nested = {}
    for (do, la, so), n in tokens.items():
        nested.setdefault(do, {}).setdefault(la, {})[so] = n
    want = {}
    dom = slow_budget(nested, budget, lambda k: {"d1": 5, "d2": 3}.get(k, 1), 2)
    for do, b in dom.items():
        for la, c in slow_budget(nested[do], b, lambda k: {"en": 7, "de": 2}.get(k, 1), 2).items():
            want |= {(do, la, so): x for so, x in slow_budget(nested[do][la], c, lambda k: {"a": 4}.get(k, 2), 2).items()}
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_plan(d, budget_tokens=budget, tree=tree).collect()}
    assert got == want


def test_mixing_edges(spark):
    rows = [(i, "a b c", "en", "src1") for i in range(20)] + [(3, "a b c", "en", "src1"), (None, "a b c", None, None), (None, "a b c", None, None), (40, "", "en", "src1"), (41, None, "en", "src1"), (42, "w " * 300_000, "de", "src9")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"__d": F.lit(1), "__cut": F.lit(2), "epochs": F.lit(3), "domain": F.lit(4), "h": F.lit(5)})
    got = mixing.select_documents(d, budget_percent=1000)
    assert got.columns == d.columns and got.count() == 2 * (len(rows) - 2)  # all there is, twice
    part = mixing.select_documents(d, "e", budget_percent=40).collect()
    ids = [(r["doc_id"], r["e"]) for r in part]
    assert ids.count((3, 0)) in (0, 2) and not {40, 41} & {i for i, _ in ids}
    assert mixing.select_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [0, 100, 10_000])
def test_shares_are_exact(spark, budget):
    d = docs(spark, ["a b c d e"] * 30)
    plan = mixing.leaf_plan(d, budget_tokens=budget).collect()
    assert sum(r["budget"] for r in plan) == min(budget, 300)
