"""Files in, stored sections out."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .operators.structure import chunks, is_noise
from .sources import pdf
from .sources.registry import read_images, read_lines
from .store import Store


def ingest(spark: SparkSession, paths: str | list[str], store: Store | None = None, tags: list[str] | None = None, config: EngineConfig | None = None, pdf_engine: pdf.Engine = pdf.PYMUPDF) -> DataFrame:
    """Structures all files of ``paths`` in one plan. Without a store gives their chunks, else saves them and gives document_key, id.

    Paths that end in ``.pdf`` are read with their figures and type sizes; with a store their pages are stored first, so each file is opened once for them.
    """
    config = config or EngineConfig()
    every = [paths] if isinstance(paths, str) else list(paths)
    papers = [p for p in every if p.lower().endswith(".pdf")]
    others = [p for p in every if p not in papers]
    lines, images = [], []
    if others:
        lines.append(read_lines(spark, others))
        images.append(read_images(spark, others))
    if papers:
        pages = pdf.read_pages(spark, papers, pdf_engine)
        if store is not None:
            path = f"{store.base}/data/pages/{uuid.uuid4().hex}"
            pages.write.parquet(path)
            pages = spark.read.parquet(path)
        found = pdf.figures(pages)
        lines.append(pdf.lines(pages, found, config.batch_pages))
        images.append(pdf.crops(spark, papers, found, pdf_engine))
    kept = reduce(DataFrame.unionByName, lines).where(~is_noise(F.col("line"), markdown=True, config=config))
    files = spark.read.format("binaryFile").load(every).select(F.col("path").alias("document_key"))
    out = chunks(kept, files, config.bad_keywords)
    if store is None:
        return out
    named = files.select("document_key", F.element_at(F.split("document_key", "/"), -1).alias("filename"), F.array(*[F.lit(t) for t in tags or []]).cast("array<string>").alias("tags"))
    return store.save(named, out, images=reduce(DataFrame.unionByName, images))


def parse_file(spark: SparkSession, path: str, store: Store | None = None, tags: list[str] | None = None, config: EngineConfig | None = None) -> dict:
    """One file in one call: filename, chunks (a table), chunk_count and, with a store, document_id and the rendered files."""
    name = path.rpartition("/")[2]
    if store is None:
        found = ingest(spark, path, config=config)
        return {"filename": name, "chunks": found, "chunk_count": found.count()}
    document_id = ingest(spark, path, store, tags, config).first()["id"]
    store.render()
    found = store._of("chunks", document_id)
    return {"filename": name, "chunks": found, "chunk_count": found.count(), "document_id": document_id}
