"""Files as rows: chunk Markdown, table of contents, index page, catalog page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LABELS
from ..functions.text import natural_key, safe_filename
from .layout import IMAGE, IMAGE_SCHEMA


def chunk_file(chunk_id: Column, number: Column, title: Column) -> Column:
    return F.concat_ws("_", chunk_id.cast("string"), safe_filename(number), F.concat(safe_filename(title), F.lit(".md")))


def _image_name(chunk_id: Column, number: Column, seq: Column) -> Column:
    return F.concat_ws("_", chunk_id.cast("string"), safe_filename(number), F.concat(seq.cast("string"), F.lit(".png")))


def _parsed() -> Column:
    """The image comments of ``content`` in order; null for those that aren't JSON or name no file."""
    read = F.transform(F.regexp_extract_all("content", F.lit(IMAGE), 1), lambda j: F.from_json(j, IMAGE_SCHEMA))
    return F.transform(read, lambda r: F.when(r["temp_path"].isNotNull(), r))


def with_images(chunks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """``chunks`` with ``refs``: an entry for each image comment, null where its picture isn't in ``images`` (document_id, temp_path); without that table all count as there."""
    x = chunks.withColumn("refs", _parsed())
    if images is None:
        return x
    have = images.groupBy(F.col("document_id").alias("d_")).agg(F.collect_set("temp_path").alias("have_"))
    x = x.join(have, F.col("document_id") == F.col("d_"), "left")
    return x.withColumn("refs", F.transform("refs", lambda r: F.when(F.array_contains(F.coalesce("have_", F.array().cast("array<string>")), r["temp_path"]), r))).drop("d_", "have_")


def _refs(chunks: DataFrame) -> DataFrame:
    """refs as structs of rel_path, caption and words; null where the comment stays. Pictures are numbered as they come."""
    x = chunks if "refs" in chunks.columns else with_images(chunks)
    seq = lambda i: F.size(F.filter(F.slice("refs", F.lit(1), i + 1), lambda r: r.isNotNull()))
    named = F.transform("refs", lambda r, i: F.when(r.isNotNull(), F.struct(F.concat(F.lit("images/"), _image_name(F.col("id"), F.col("section_number"), seq(i))).alias("rel_path"), F.coalesce(r["caption"], F.concat(F.lit("Image "), seq(i).cast("string"))).alias("caption"), r["contained_text"].alias("words"), r["temp_path"].alias("temp_path"))))
    return x.withColumn("refs", named)


def image_files(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """(document_id, rel_path, data): where each picture goes."""
    x = _refs(chunks).select(F.col("document_id").alias("c_"), F.explode(F.filter("refs", lambda r: r.isNotNull())).alias("r")).select("c_", "r.rel_path", F.col("r.temp_path").alias("t_"))
    return x.join(images, (F.col("c_") == F.col("document_id")) & (F.col("t_") == F.col("temp_path"))).select("document_id", "rel_path", "data")


def chunk_markdown(chunks: DataFrame, documents: DataFrame, locale: str = "en") -> DataFrame:
    """(id, document_id, file, markdown): heading, metadata, content with image links, figures with the words in them."""
    t = LABELS["zh" if locale.lower().startswith("zh") else "en"]
    d = documents.select(F.col("id").alias("d_"), "filename")
    x = _refs(chunks).join(d, F.col("document_id") == F.col("d_")).withColumn("texts", F.split("content", IMAGE)).withColumn("comments", F.regexp_extract_all("content", F.lit(IMAGE), 0))
    there = F.filter("refs", lambda r: r.isNotNull())
    link = lambda i: F.when(F.get("refs", i).isNotNull(), F.concat(F.lit("\n!["), F.get("refs", i)["caption"], F.lit("](../"), F.get("refs", i)["rel_path"], F.lit(")\n"))).otherwise(F.coalesce(F.get("comments", i), F.lit("")))
    body = F.array_join(F.transform("texts", lambda s, i: F.concat(s, link(i))), "")
    names = F.array_join(F.transform(there, lambda r: F.concat(F.lit("\n  - output/"), F.col("document_id").cast("string"), F.lit("/"), r["rel_path"])), "")
    said = F.array_join(F.transform(there, lambda r: F.concat(F.lit(f"\n- **{t['image']}: "), r["caption"], F.lit("** ("), r["rel_path"], F.lit(")"), F.when(F.size(r["words"]) > 0, F.concat(F.lit(f"\n  - {t['text']}: "), F.array_join(F.transform(r["words"], lambda w: w["text"]), ", "))).otherwise(""))), "")
    some = F.size(there) > 0
    md = F.concat(
        F.lit("# "), "section_number", F.lit(" "), "title", F.lit("\n\nmetadata:\n- source file: "), "filename", F.lit("\n- section number: "), "section_number", F.lit("\n- page start: "), F.col("page_start").cast("string"),
        F.when(some, F.concat(F.lit("\n- images:"), names)).otherwise(""), F.lit("\n\ncontent:\n"), body, F.when(some, F.concat(F.lit(f"\n\n{t['diagrams']}"), said)).otherwise(""),
    )
    return x.select("id", "document_id", chunk_file(F.col("id"), F.col("section_number"), F.col("title")).alias("file"), md.alias("markdown"))


def toc(chunks: DataFrame) -> DataFrame:
    """All sections in natural order within their document: document_id, place, id, section_number, title, page_start, file_path if there is one."""
    w = Window.partitionBy("document_id").orderBy(natural_key(F.col("section_number")), "id")
    return chunks.select("document_id", F.row_number().over(w).alias("place"), "id", "section_number", "title", "page_start", *[c for c in ("file_path",) if c in chunks.columns])


def toc_json(chunks: DataFrame) -> DataFrame:
    """(document_id, toc): JSON arrays of the sections in order of id, without the introduction; ``images`` where there are some."""
    paths = F.transform(F.filter("refs", lambda r: r.isNotNull()), lambda r: r["rel_path"])
    entry = F.struct("id", "section_number", "title", chunk_file(F.col("id"), F.col("section_number"), F.col("title")).alias("file"), "page_start", F.when(F.size(paths) > 0, paths).alias("images"))
    x = _refs(chunks).where("section_number <> '0'").groupBy("document_id").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    return x.select("document_id", F.to_json("t").alias("toc"))


def index_page(chunks: DataFrame, locale: str = "en") -> DataFrame:
    """(document_id, page): a tree of files and a nested list of links with their pictures, in natural order."""
    t = LABELS["zh" if locale.lower().startswith("zh") else "en"]
    file = chunk_file(F.col("id"), F.col("section_number"), F.col("title"))
    paths = F.transform(F.filter("refs", lambda r: r.isNotNull()), lambda r: r["rel_path"])
    x = _refs(chunks).where("section_number <> '0'").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(natural_key(F.col("section_number")).alias("k"), "id", "section_number", "title", file.alias("file"), paths.alias("images")))).alias("s"))
    tree = F.array_join(F.transform("s", lambda e, i: F.concat(F.when(i == F.size("s") - 1, "└── ").otherwise("├── "), e["file"], F.lit("\n"))), "")
    indent = lambda n: F.repeat(F.lit("  "), F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))))
    shown = lambda e: F.array_join(F.transform(e["images"], lambda p: F.concat(indent(e["section_number"]), F.lit(f"  - [{t['image']}: "), F.replace(p, F.lit("images/"), F.lit("")), F.lit("]("), p, F.lit(")\n"))), "")
    links = F.array_join(F.transform("s", lambda e: F.concat(indent(e["section_number"]), F.lit("- ["), e["section_number"], F.lit(" "), e["title"], F.lit("](chunks/"), e["file"], F.lit(")\n"), shown(e))), "")
    return x.select("document_id", F.concat(F.lit(f"{t['index']}\n\n{t['tree']}\n\n```text\n"), tree, F.lit(f"```\n\n{t['list']}\n\n"), links).alias("page"))


def _catalog_rows(documents: DataFrame, tags: DataFrame, locale: str) -> DataFrame:
    t = LABELS["zh" if locale.lower().startswith("zh") else "en"]
    g = tags.select(F.col("document_id").alias("d_"), "tag")
    x = documents.join(g, F.col("id") == F.col("d_"), "left").withColumn("untagged", F.col("tag").isNull().cast("int"))
    line = F.concat(F.lit("- ["), "filename", F.lit(" (ID: "), F.col("id").cast("string"), F.lit(")]("), F.col("id").cast("string"), F.lit(f"/index.md) - *{t['uploaded']}: "), "upload_time", F.lit("*\n"))
    return x.select("untagged", "tag", F.concat(F.lit("## "), F.coalesce("tag", F.lit(t["untagged"]))).alias("heading"), "upload_time", "id", line.alias("line"))


def catalog_lines(documents: DataFrame, tags: DataFrame, locale: str = "en") -> DataFrame:
    """(heading, line) of the catalog, sorted over ranges: tags in order, newest documents first, untagged ones last."""
    return _catalog_rows(documents, tags, locale).orderBy("untagged", "tag", F.desc("upload_time"), F.desc("id")).select("heading", "line")


def catalog_page(documents: DataFrame, tags: DataFrame, locale: str = "en") -> DataFrame:
    """(place, heading, body): a section a tag in order. Holds a tag's documents in one row; ``catalog_lines`` doesn't."""
    x = _catalog_rows(documents, tags, locale).groupBy("untagged", "tag", "heading").agg(F.reverse(F.array_sort(F.collect_list(F.struct("upload_time", "id", "line")))).alias("s"))
    # one row a tag
    return x.select(F.row_number().over(Window.orderBy("untagged", "tag")).alias("place"), "heading", F.array_join(F.transform("s", lambda e: e["line"]), "").alias("body"))
