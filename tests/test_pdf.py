import json
import re
from types import SimpleNamespace

from sectionwise.api import ingest
from sectionwise.operators.structure import chunks
from sectionwise.sources import pdf, registry
from sectionwise.store import Store


class Page:
    def __init__(self, spec):
        self.spec, self.rect = spec, SimpleNamespace(width=600.0, height=800.0)

    def get_drawings(self):
        return [{"rect": r} for r in self.spec.get("drawings", [])]

    def get_image_info(self):
        if "pictures" not in self.spec:
            raise RuntimeError("broken page")
        return [{"bbox": r} for r in self.spec["pictures"]]

    def get_text(self, kind):
        rows = self.spec["lines"]
        if kind == "words":
            return [(x0, y, x0 + 9 * len(t), y + s, t.split()[0], 0, 0, 0) for x0, y, s, t in rows if t.strip()]
        if kind == "blocks":
            return [(x0, y, x0 + 9 * len(t), y + s, t + "\n", n, 0) for n, (x0, y, s, t) in enumerate(rows)]
        return {"blocks": [{"lines": [{"bbox": (x0, y, x0 + 9 * len(t), y + s), "spans": [{"text": t, "size": s}]}]} for x0, y, s, t in rows] + [{"type": 1}]}


class Doc(list):
    def __init__(self, spec):
        super().__init__(Page(p) for p in spec["pages"])
        self.spec = spec

    def get_toc(self):
        return self.spec["toc"]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


SPEC = {
    "toc": [[1, "1 Start", 1], [2, "1.1 Power", 2], [1, "Lost", 9]],
    "pages": [
        {"pictures": [], "lines": [(50, 60, 20, "1 Start"), (50, 90, 10, "body text of the first page"), (50, 110, 10, "and more of it")]},
        {
            "pictures": [[100, 210, 180, 260]], "drawings": [[100, 150, 180, 200], [20, 300, 580, 302], [10, 10, 90, 30]],
            "lines": [(50, 60, 14, "Power"), (50, 90, 10, "before the figure"), (110, 160, 10, "label"), (50, 270, 10, "Figure 7"), (50, 300, 10, "after the figure")],
        },
        {"lines": [(50, 60, 10, "last page"), (50, 90, 10, "  ")]},
    ],
}


def opened(data):
    return Doc(json.loads(data))


def crop(doc, w, zoom):
    return f"{w['page']}:{[round(w[k]) for k in ('x0', 'y0', 'x1', 'y1')]}:{zoom}".encode()


ENGINE = pdf.Engine(opened, crop)


def test_pages_to_chunks(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(json.dumps(SPEC))
    path = str(tmp_path / "a.pdf")
    pages = pdf.read_pages(spark, path, ENGINE)
    kinds = {r["kind"]: r["count"] for r in pages.groupBy("kind").count().collect()}
    assert kinds == {"bookmark": 3, "page": 3, "drawing": 3, "picture": 1, "word": 9, "block": 10, "line": 10}
    found = pdf.figures(pages)
    (f,) = found.collect()
    assert (f["page"], f["box"], f["x0"], f["y0"], f["x1"], f["y1"], f["caption"], f["temp_path"]) == (2, 1, 100, 150, 180, 260, "Figure 7", "page_2_1.png")
    assert [w["text"] for w in f["contained_text"]] == ["label"]
    got = [(r["page"], r["line"]) for r in pdf.lines(pages, found).orderBy("line_no").collect()]
    comment = got[5][1]
    assert got[:5] == [(1, "# 1 Start"), (1, "body text of the first page"), (1, "and more of it"), (2, "## Power"), (2, "before the figure")]
    assert json.loads(re.fullmatch("<!-- IMAGE: (.*) -->", comment)[1])["caption"] == "Figure 7"
    assert [x for _, x in got[6:]] == ["Figure 7", "after the figure", "last page"]
    assert [(r["temp_path"], bytes(r["data"])) for r in pdf.crops(spark, path, found, ENGINE).collect()] == [("page_2_1.png", b"2:[100, 150, 180, 260]:2.0")]
    sections = [(r["number"], r["title"], r["page_start"]) for r in chunks(pdf.lines(pages, found)).orderBy("seg").collect()]
    assert sections == [("1", "Start", 1), ("1.1", "Power", 2)]
    assert pdf.figures(pages.limit(0)).count() == pdf.lines(pages.limit(0), found.limit(0)).count() == 0
    assert ".pdf" in registry.formats()


def test_pdf_into_the_store(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(json.dumps(SPEC))
    (tmp_path / "b.md").write_text("# Other\ntext")
    store = Store(spark, str(tmp_path / "s"))
    ingest(spark, [str(tmp_path / "a.pdf"), str(tmp_path / "b.md")], store, pdf_engine=ENGINE)
    store.render()
    assert [r["filename"] for r in store.documents().orderBy("id").collect()] == ["a.pdf", "b.md"]
    assert [(r["section_number"], r["page_start"]) for r in store.toc(1).collect()] == [("1", 1), ("1.1", 2)]
    (md,) = (tmp_path / "s/output/1/chunks").glob("*_1.1_Power.md")
    (link,) = re.findall(r"!\[Figure 7\]\((.*?)\)", md.read_text())
    assert (md.parent / link).read_bytes().startswith(b"2:[100, 150, 180, 260]") and ": label" in md.read_text()
    assert [r["title"] for r in store.search("before_the_figure").collect()] == ["Power"]
