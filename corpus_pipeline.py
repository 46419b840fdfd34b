"""From documents to packed sequences: quality rules, near-duplicates, surrogates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of documents; the last returns packing's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionwise.llm.common import durable, read
from sectionwise.llm.dedup import keep_one
from sectionwise.llm.mixing import select_documents
from sectionwise.llm.packing import pack
from sectionwise.llm.pii import rewrite
from sectionwise.llm.quality import accept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go.

    Null, empty and wordless texts are rejected; null lang or source is a group; a value on a fence stays; repeated rows
    share their fate; very long texts are measured whole; an empty table stays empty; further columns, whatever their names, pass.
    """
    return accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of least doc_id.

    Rows without doc_id, text or words stay; of rows with one doc_id one stays; very long texts are aligned whole; an empty
    table stays empty; further columns pass.
    """
    return keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the new text.

    Null and empty texts stay, and n_chars of a null text is null; rows with null doc_id are rewritten too; repeated rows get
    the same text; very long texts are searched whole; an empty table stays empty; further columns pass.
    """
    out = rewrite(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The budget's documents, a row for each epoch that takes them.

    Null, empty and wordless texts are never taken; null lang or source is a child of its own; null doc_id is hashed as ''; rows
    with one doc_id are taken or left together; very long texts count whole; an empty table stays empty; further columns pass.
    """
    return select_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the curve.

    Null, empty and wordless texts are not packed; null doc_id sorts first; repeated rows are packed as often as they occur; very long
    texts fill several sequences; equal keys are ordered by doc_id; an empty table gives no rows; further columns don't matter.
    """
    return pack(docs)


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("PII", surrogates), ("mixing sources to target weights", mixing), ("packing", packing)]
#: Order MinHash, banded alignment and keyed surrogates have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
