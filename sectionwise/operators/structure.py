"""Lines to chunks: noise, headings, section numbers and the fold, all on one (document, line) order.

Lines are ``document_key, line_no, page, line``. Numbers come from running sums and last values over
one window specification a document, so the plan has one exchange and one sort, and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BANNER, BANNER_LENGTH, EngineConfig
from ..functions.text import strip, trim_marks

DEPTHS = 10
_CI = "(?iuUd)"
_MARKED = "(?Ud)^(#+)\\s*(?:\\*\\*\\s*)?(.*?)(?:\\s*\\*\\*)?$"
_NUMBERED = _CI + "^(?:chapter|section|第)?\\s*(\\d+(?:\\.\\d+)*)\\.?(?:[\\s:-]+((?s:.*)))?$"
_QUANTITY = _CI + "^\\d+(?:\\.\\d+)?\\s*(MHz|GHz|W|V|A|mV|mA|s|ns|ms|us|bytes|KB|MB|GB|TB)$"


def is_noise(line: Column, markdown: bool = False, config: EngineConfig | None = None) -> Column:
    config = config or EngineConfig()
    x = strip(line)
    # one alternation, as each use of x strips anew
    every = ["(?Ud:\\.{3,}\\s*\\d+$)", *(f"(?iuUd:{p})" for p in config.noise())]
    out = x.rlike("|".join(every)) | (F.length(x) <= BANNER_LENGTH) & x.rlike(f"(?s)^(?!.*\\n).*(?iuUd:{BANNER})")
    if not markdown:
        out = out | x.rlike("(?U)^\\d*$")
    return out


def valid_heading(number: Column, title: Column, bad_keywords: tuple[str, ...]) -> Column:
    major = F.split(number, "\\.")[0].try_cast("decimal(38,0)")
    low = F.lower(title)
    out = F.coalesce(major.between(1, 99), F.lit(False)) & (F.length(title) <= 120) & title.rlike("[a-zA-Z0-9一-鿿]")
    out = out & ~F.concat_ws(" ", number, title).rlike(_QUANTITY) & ~number.rlike("^[^.]*\\.0[^.]+$")
    for k in bad_keywords:
        out = out & ~low.contains(k)
    return out


def classify(lines: DataFrame, bad_keywords: tuple[str, ...] | None = None) -> DataFrame:
    """Adds level, explicit, title, event (SYNC, GEN or NONE). A GEN may still turn out to be no heading."""
    keys = EngineConfig().bad_keywords if bad_keywords is None else bad_keywords
    x = lines.withColumn("__s", strip(F.col("line")))
    marked = F.col("__s").rlike(_MARKED)
    x = x.withColumn("level", F.when(marked, F.length(F.regexp_extract("__s", _MARKED, 1))).otherwise(0))
    x = x.withColumn("__t", F.when(F.col("level") > 0, trim_marks(F.regexp_extract("__s", _MARKED, 2))).otherwise(F.col("__s")))
    x = x.withColumn("explicit", F.regexp_extract("__t", _NUMBERED, 1))
    given = trim_marks(F.coalesce(F.nullif(F.regexp_extract("__t", _NUMBERED, 2), F.lit("")), F.lit("Overview")))
    x = x.withColumn("title", F.when(F.col("explicit") != "", given).when(F.col("level") > 0, F.col("__t")))
    sync = (F.col("explicit") != "") & valid_heading(F.col("explicit"), F.col("title"), keys)
    event = F.when(sync, "SYNC").when((F.col("explicit") == "") & F.col("level").between(1, DEPTHS), "GEN").otherwise("NONE")
    return x.withColumn("event", event).drop("__s", "__t")


def number_sections(classified: DataFrame) -> DataFrame:
    """Adds ``number``: the text itself for SYNC, the counters for GEN."""
    w = Window.partitionBy("document_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split(F.col("explicit"), "\\.")
    big = "decimal(38,0)"
    gen, sync = F.col("event") == "GEN", F.col("event") == "SYNC"
    x = classified
    x = x.select("*", *[F.sum(F.when(gen & (F.col("level") == d), 1).otherwise(0)).over(w).alias(f"__n{d}") for d in range(1, DEPTHS + 1)])
    sets = [F.when(sync, F.when(F.size(parts) >= d, F.coalesce(F.get(parts, F.lit(d - 1)).try_cast(big), F.lit(1).cast(big))).otherwise(F.lit(0).cast(big))).when(gen & (F.col("level") < d), F.lit(0).cast(big)) for d in range(1, DEPTHS + 1)]
    x = x.select("*", *[F.last(s - F.col(f"__n{d}"), ignorenulls=True).over(w).alias(f"__b{d}") for d, s in enumerate(sets, 1)])
    slots = F.array(*[F.greatest(F.col(f"__n{d}") + F.coalesce(F.col(f"__b{d}"), F.lit(0)), F.lit(1)).cast(big).cast("string") for d in range(1, DEPTHS + 1)])
    number = F.when(sync, F.col("explicit")).when(gen, F.array_join(F.slice(slots, F.lit(1), F.col("level")), "."))
    return x.withColumn("number", number).drop(*[f"__{k}{d}" for k in "nb" for d in range(1, DEPTHS + 1)])


def headings(lines: DataFrame, bad_keywords: tuple[str, ...] | None = None) -> DataFrame:
    """All lines with event, number, title and is_heading."""
    keys = EngineConfig().bad_keywords if bad_keywords is None else bad_keywords
    # classified after the shuffle, which so carries each line once, without its title, number and event
    x = number_sections(classify(lines.repartition("document_key"), keys))
    ok = (F.col("event") == "SYNC") | ((F.col("event") == "GEN") & F.coalesce(valid_heading(F.col("number"), F.col("title"), keys), F.lit(False)))
    return x.withColumn("is_heading", ok)


def chunks(lines: DataFrame, documents: DataFrame | None = None, bad_keywords: tuple[str, ...] | None = None, headed: bool = True) -> DataFrame:
    """document_key, seg, number, title, content, page_start. ``documents`` (document_key) gives lineless ones their empty chunk. If not ``headed``, no line is a heading, whatever it looks like."""
    none = F.lit(None).cast("string")
    if documents is not None:
        # a row without a number before the lines of each document; it stays where it is the only one
        kind = lines.schema
        bare = documents.select("document_key").distinct()
        lines = lines.select("document_key", "line_no", "page", "line").unionByName(bare.select("document_key", *[F.lit(None).cast(kind[c].dataType).alias(c) for c in ("line_no", "page", "line")]))
    x = headings(lines, bad_keywords) if headed else lines.withColumns({"is_heading": F.lit(False), "number": none, "title": none})
    w = Window.partitionBy("document_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("seg", F.sum(F.col("is_heading").cast("int")).over(w))
    if documents is not None:
        after = F.lead(F.lit(True)).over(Window.partitionBy("document_key").orderBy("line_no"))
        x = x.withColumn("__last", after.isNull()).where(F.col("line_no").isNotNull() | F.col("__last")).drop("__last")
    head = F.col("is_heading")
    body = F.collect_list(F.when(~head, F.struct("line_no", "line")))
    x = x.groupBy("document_key", "seg").agg(
        F.coalesce(F.max(F.when(head, F.col("number"))), F.lit("0")).alias("number"),
        F.coalesce(F.max(F.when(head, F.col("title"))), F.lit("Introduction")).alias("title"),
        strip(F.array_join(F.transform(F.array_sort(body), lambda s: s["line"]), "\n")).alias("content"),
        F.coalesce(F.max(F.when(head, F.col("page"))), F.lit(1)).cast("int").alias("page_start"),
    )
    return x.withColumn("seg", F.col("seg").cast("int"))


def merge_split_headings(lines: DataFrame) -> DataFrame:
    """A bare number takes the next line, unless that is a bare number too."""
    w = Window.partitionBy("document_key").orderBy("line_no")
    bare = strip(F.col("line")).rlike("(?U)^\\d+(?:\\.\\d+)*\\.?$")
    x = lines.withColumn("__bare", bare).withColumn("__next", F.lead("line").over(w)).withColumn("__nb", F.lead("__bare").over(w)).withColumn("__pb", F.lag("__bare").over(w))
    joined = F.when(F.col("__bare") & ~F.coalesce(F.col("__nb"), F.lit(True)), F.concat(strip(F.col("line")), F.lit(" "), strip(F.col("__next")))).otherwise(F.col("line"))
    return x.where(F.col("__bare") | ~F.coalesce(F.col("__pb"), F.lit(False))).withColumn("line", joined).drop("__bare", "__next", "__nb", "__pb")


def promote_styles(paragraphs: DataFrame, bold_always: bool = False) -> DataFrame:
    """Paragraphs (text, style, runs of text and bold) get the ``#`` of their style."""
    level = F.regexp_extract("style", "^Heading ([0-9]+)$", 1).try_cast("int")
    bold = (F.length("text") < 80) & (F.size(F.filter("runs", lambda r: strip(r["text"]) != "")) > 0) & F.forall(F.filter("runs", lambda r: strip(r["text"]) != ""), lambda r: F.coalesce(r["bold"], F.lit(False)))
    plain = F.lit(True) if bold_always else F.coalesce(F.col("style"), F.lit("")) == ""
    mark = F.when(level.isNotNull(), F.repeat(F.lit("#"), level)).when(F.col("style") == "Title", "#").when(F.col("style") == "Subtitle", "##").when(plain & bold, "##")
    return paragraphs.withColumn("line", F.when(mark.isNotNull(), F.concat(mark, F.lit(" "), F.col("text"))).otherwise(F.col("text")))
