"""Command line: parse, tag, list, toc, get-chunk, search, delete."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import parse_file
from .config import EngineConfig
from .store import Store


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sectionwise")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--base-dir")
    p.add_argument("--locale", choices=["en", "zh"])
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {"parse": ("file", "output", "tags?"), "tag": ("doc-id#", "tags"), "list": ("output",), "toc": ("doc-id#", "output"), "get-chunk": ("chunk-id#", "output"), "search": ("query", "output", "doc-id#?"), "delete": ("doc-id#",)}.items():
        s = sub.add_parser(name)
        for o in options:
            s.add_argument("--" + o.strip("#?"), required=not o.endswith("?"), type=int if "#" in o else str)
    a = p.parse_args(argv)
    given = {k: v for k, v in (("base_dir", a.base_dir), ("locale", a.locale)) if v}
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose > 1 else "WARN" if a.verbose else "ERROR")
    store = Store(spark, config=EngineConfig(**given))
    try:
        if a.command == "parse":
            tags = [t.strip() for t in (a.tags or "").split(",") if t.strip()]
            done = parse_file(spark, a.file, store, tags, store.config)
            result = {"success": True, "document_id": done["document_id"], "filename": done["filename"], "chunk_count": done["chunk_count"]}
        elif a.command == "tag":
            store.set_tags(a.doc_id, a.tags.split(","))
            print(f"document {a.doc_id}: {a.tags}")
            return 0
        elif a.command == "delete":
            name = store.delete(a.doc_id)
            print(f"deleted {name}" if name else f"no document {a.doc_id}", file=sys.stdout if name else sys.stderr)
            return 0 if name else 1
        elif a.command == "list":
            result = {"documents": _rows(store.documents())}
        elif a.command == "toc":
            result = {"toc": _rows(store.toc(a.doc_id))}
        elif a.command == "get-chunk":
            found = _rows(store.chunk(a.chunk_id))
            if not found:
                print(f"no chunk {a.chunk_id}", file=sys.stderr)
                return 1
            result = {"chunk": found[0]}
        else:
            result = {"results": _rows(store.search(a.query, a.doc_id))}
        with open(a.output, "w", encoding="utf-8") as f:
            json.dump(result, f, ensure_ascii=False, indent=2)
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
