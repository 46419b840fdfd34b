import random

import pytest

from sectionwise.operators import structure

LINES = "document_key string, line_no int, page int, line string"


def one(spark, line):
    df = spark.createDataFrame([("d", 0, 1, line)], LINES)
    r = structure.headings(df).first()
    return (r["number"], r["title"]) if r["is_heading"] else None


@pytest.mark.parametrize(("line", "want"), [
    ("5", ("5", "Overview")), ("3 apples", ("3", "apples")), ("12:30 call", ("12", "30 call")), ("2024", None), ("第3章 X", None), ("第3 X", ("3", "X")),
    ("# 5 GHz", None), ("####", None), ("1.05 x", None), ("12-05-2024 report", ("12", "05-2024 report")), ("10.5mm bolts", None), ("# Contents", ("1", "Contents")),
    ("# **Bold** ", ("1", "Bold")), ("## Revision History", None), ("#" * 11 + " deep", None), ("# Заголовок", None), ("1 " + "x" * 121, None), ("#tag", ("1", "tag")),
])
def test_headings(spark, line, want):
    assert one(spark, line) == want


def test_numbers_match_a_sequential_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(20):
        slots = [0] * 10
        for n in range(60):
            if rng.random() < 0.5:
                level = rng.randint(1, 8)
                rows.append((str(d), n, 1, "#" * level + " word"))
                slots[level - 1] += 1
                slots[level:] = [0] * (10 - level)
                want[str(d), n] = ".".join(str(max(s, 1)) for s in slots[:level])
            else:
                parts = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
                num = ".".join(map(str, parts))
                rows.append((str(d), n, 1, f"{num} word"))
                slots = (parts + [0] * 10)[:10]
                want[str(d), n] = num
    got = {(r["document_key"], r["line_no"]): r["number"] for r in structure.headings(spark.createDataFrame(rows, LINES)).collect()}
    assert got == want


def test_chunks_of_empty_documents(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_key string")
    lines = spark.createDataFrame([("a", 0, 1, "  "), ("a", 1, 2, "# One"), ("a", 2, 2, "x"), ("a", 3, 3, "y")], LINES)
    got = sorted((r["document_key"], r["number"], r["title"], r["content"], r["page_start"]) for r in structure.chunks(lines, docs).collect())
    assert got == [("a", "0", "Introduction", "", 1), ("a", "1", "One", "x\ny", 2), ("b", "0", "Introduction", "", 1)]


def test_chunks_read_the_lines_once(spark):
    """Also to find the documents without any, of which one may be named twice; before, a second scan looked for them."""
    docs = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "document_key string")
    lines = spark.createDataFrame([("a", 0, 1, "# One"), ("c", 0, 1, "x"), ("c", 1, 1, "2 Two"), ("z", 4, 1, "y")], LINES)
    for headed in (True, False):
        x = structure.chunks(lines, docs, headed=headed)
        got = sorted((r["document_key"], r["seg"], r["number"], r["content"]) for r in x.collect())
        split = [("a", 1, "1", ""), ("b", 0, "0", ""), ("c", 0, "0", "x"), ("c", 1, "2", ""), ("z", 0, "0", "y")]
        assert got == (split if headed else [("a", 0, "0", "# One"), ("b", 0, "0", ""), ("c", 0, "0", "x\n2 Two"), ("z", 0, "0", "y")])
        assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
