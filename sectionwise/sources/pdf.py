"""PDF pages as relations: page sizes, bookmarks, drawings, pictures, words, text blocks and lines; figures from them.

A task opens one file at a time; what follows is joins and windows of operators.layout. PyMuPDF is looked for only when a PDF is read.

Headings come from type size: the commonest size of a document (by characters) is its body, larger ones are levels 1 to 6
from the largest down. Lines that lie in a figure give way to the figure's comment, which stands where the figure begins. A heading's
page is that of the bookmark it matches within its batch of pages, else the page it stands on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import layout

ROWS = "document_key string, kind string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string, number int, size double"
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_FIELDS = [tuple(f.split()) for f in ROWS.split(", ")]
LEVELS = 6
SHARE = 0.8


def page_rows(doc) -> Iterator[tuple]:
    """(kind, page, ord, x0, y0, x1, y1, text, number, size) of an open document. What a page can't give is left out."""

    def ask(call, *args, **kw) -> list:
        try:
            return list(call(*args, **kw))
        except Exception:  # noqa: BLE001
            return []

    for n, (_, title, page) in enumerate(ask(doc.get_toc)):
        yield "bookmark", page, n, None, None, None, None, title, None, None
    for p, page in enumerate(doc, 1):
        r = page.rect
        yield "page", p, 0, 0.0, 0.0, float(r.width), float(r.height), None, None, None
        for n, d in enumerate(ask(page.get_drawings)):
            yield "drawing", p, n, *map(float, d["rect"]), None, None, None
        for n, d in enumerate(ask(page.get_image_info)):
            yield "picture", p, n, *map(float, d["bbox"]), None, None, None
        for n, w in enumerate(ask(page.get_text, "words")):
            yield "word", p, n, *map(float, w[:4]), w[4], None, None
        for n, b in enumerate(ask(page.get_text, "blocks")):
            yield "block", p, n, *map(float, b[:4]), b[4], int(b[6]), None
        n = 0
        for b in page.get_text("dict").get("blocks", []):
            for line in b.get("lines", []):
                spans = line["spans"]
                yield "line", p, n, *map(float, line["bbox"]), "".join(s["text"] for s in spans), None, max((float(s["size"]) for s in spans), default=0.0)
                n += 1


def _open(data: bytes):
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF needs PyMuPDF") from e
    return fitz.open(stream=data, filetype="pdf")


def _crop(doc, w: dict, zoom: float) -> bytes:
    import fitz

    return doc[w["page"] - 1].get_pixmap(matrix=fitz.Matrix(zoom, zoom), clip=fitz.Rect(w["x0"], w["y0"], w["x1"], w["y1"])).tobytes("png")


@dataclass(frozen=True)
class Engine:
    """What opens a file's bytes, and what draws a box {page, x0, y0, x1, y1} of it as PNG."""

    opened: Callable
    crop: Callable


PYMUPDF = Engine(_open, _crop)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("document_key"), "content")


def read_pages(spark: SparkSession, paths: str | list[str], engine: Engine = PYMUPDF) -> DataFrame:
    """ROWS of all files; store it once (``Store`` folder or any table) before several relations are taken from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with engine.opened(data.as_py()) as doc:
                    rows = [(key, *r) for r in page_rows(doc)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return _files(spark, paths).mapInArrow(run, ROWS)


def figures(pages: DataFrame) -> DataFrame:
    """document_key, page, box, x0, y0, x1, y1, caption, contained_text, temp_path: clusters of drawings and pictures, in order down the page."""
    size = pages.where("kind = 'page'").select(F.col("document_key").alias("k_"), F.col("page").alias("p_"), F.col("x1").alias("page_width"), F.col("y1").alias("page_height"))
    place = (F.col("document_key") == F.col("k_")) & (F.col("page") == F.col("p_"))

    def sized(x: DataFrame) -> DataFrame:
        return x.join(size, place).drop("k_", "p_")

    rects = ["document_key", "page", "x0", "y0", "x1", "y1", "page_width", "page_height"]
    boxes = layout.figure_rects(*[sized(pages.where(F.col("kind") == k)).select(rects) for k in ("drawing", "picture")])
    found = layout.clip(sized(layout.clusters(boxes))).select("document_key", "page", "x0", "y0", "x1", "y1")
    found = found.withColumn("box", F.row_number().over(Window.partitionBy("document_key", "page").orderBy("y0", "x0", "y1", "x1")))
    blocks = pages.where("kind = 'block'").select("document_key", "page", "y0", "y1", "text", F.col("ord").alias("block_no"), F.col("number").alias("block_type"))
    words = pages.where("kind = 'word'").withColumn("text", F.struct("ord", "text"))
    said = layout.contained_words(found, words, SHARE).groupBy("document_key", "page", "box").agg(F.array_sort(F.collect_list(F.struct("text.ord", "text.text", "bbox"))).alias("w"))
    said = said.select(F.col("document_key").alias("k_"), F.col("page").alias("p_"), F.col("box").alias("b_"), F.transform("w", lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"))).alias("contained_text"))
    named = layout.captions(found, blocks).select(F.col("document_key").alias("k2_"), F.col("page").alias("p2_"), F.col("box").alias("b2_"), "caption")
    x = found.join(named, (F.col("document_key") == F.col("k2_")) & (F.col("page") == F.col("p2_")) & (F.col("box") == F.col("b2_"))).join(said, place & (F.col("box") == F.col("b_")), "left")
    none = F.array().cast("array<struct<text:string,bbox:array<double>>>")
    return x.select("document_key", "page", "box", "x0", "y0", "x1", "y1", "caption", F.coalesce("contained_text", none).alias("contained_text"), F.format_string("page_%d_%d.png", "page", "box").alias("temp_path"))


def crops(spark: SparkSession, paths: str | list[str], found: DataFrame, engine: Engine = PYMUPDF, zoom: float = 2.0) -> DataFrame:
    """document_key, temp_path, data: a PNG of each figure, drawn at ``zoom``; a file's boxes go to the task that opens it."""
    boxes = found.groupBy(F.col("document_key").alias("k_")).agg(F.collect_list(F.struct("temp_path", "page", "x0", "y0", "x1", "y1")).alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                with engine.opened(data.as_py()) as doc:
                    for w in want:
                        png = engine.crop(doc, w, zoom)
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([w["temp_path"]]), pa.array([png], pa.binary())], ["document_key", "temp_path", "data"])

    return _files(spark, paths).join(boxes, F.col("document_key") == F.col("k_")).select("document_key", "content", "boxes").mapInArrow(run, "document_key string, temp_path string, data binary")


def lines(pages: DataFrame, found: DataFrame, batch_pages: int = 50) -> DataFrame:
    """document_key, line_no, page, line: Markdown headings by type size, a comment where a figure begins, pages by bookmarks."""
    x = pages.where("kind = 'line'").select("document_key", "page", "ord", "x0", "y0", "x1", "y1", F.col("text").alias("line"), "size")
    inside = layout.contained_words(found.select("document_key", "page", "box", "x0", "y0", "x1", "y1"), x.withColumn("text", F.col("ord")), SHARE)
    inside = inside.select(F.col("document_key").alias("k_"), F.col("page").alias("p_"), F.col("text").alias("o_")).distinct()
    x = x.join(inside, (F.col("document_key") == F.col("k_")) & (F.col("page") == F.col("p_")) & (F.col("ord") == F.col("o_")), "left_anti").where(strip(F.col("line")) != "")
    sizes = x.groupBy("document_key", "size").agg(F.sum(F.length("line")).alias("n"))
    ranked = sizes.groupBy(F.col("document_key").alias("k_")).agg(F.max_by("size", F.struct("n", "size")).alias("body"), F.array_sort(F.collect_set("size"), lambda a, b: F.sign(b - a).cast("int")).alias("sizes"))
    x = x.join(ranked, F.col("document_key") == F.col("k_"))
    level = F.least(F.array_position("sizes", F.col("size")), F.lit(LEVELS)).cast("int")
    mark = F.when((F.col("size") > F.col("body")) & ~F.col("line").startswith("#"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).otherwise("")
    text = x.select("document_key", "page", "y0", F.lit(1).alias("rank"), F.col("ord").alias("o"), F.concat(mark, "line").alias("line"))
    comment = F.concat(F.lit("<!-- IMAGE: "), F.to_json(F.struct("temp_path", "caption", "contained_text")), F.lit(" -->"))
    shown = found.select("document_key", "page", "y0", F.lit(0).alias("rank"), F.col("box").alias("o"), comment.alias("line"))
    # a line stands after the figures that begin above it; lines keep their own order
    flow = text.unionByName(shown)
    w = Window.partitionBy("document_key", "page").orderBy("y0", "rank", "o")
    top = F.max(F.when(F.col("rank") == 1, F.col("o"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    flow = flow.withColumn("at", F.when(F.col("rank") == 1, F.col("o")).otherwise(F.coalesce(top, F.lit(-1))))
    order = Window.partitionBy("document_key").orderBy("page", "at", F.desc("rank"), "o")
    flow = flow.select("document_key", (F.row_number().over(order) - 1).alias("line_no"), "page", "line")
    marks = layout.bookmark_titles(pages.where("kind = 'bookmark'").select("document_key", "ord", F.col("text").alias("title"), "page"))
    numbered = flow.withColumns({"batch": F.expr(f"cast((page - 1) div {int(batch_pages)} as int)"), "is_marked": F.col("line").startswith("#"), "own": F.col("page")}).drop("page")
    by_mark = layout.resolve_pages(numbered, marks, batch_pages)
    first = F.expr(f"batch * {int(batch_pages)} + 1")
    return by_mark.select("document_key", "line_no", F.when(F.col("page") == first, F.col("own")).otherwise(F.col("page")).cast("int").alias("page"), "line")
