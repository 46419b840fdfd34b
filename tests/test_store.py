import io
import json
import re
import zipfile

import pytest

from sectionwise import cli
from sectionwise.api import ingest, parse_file
from sectionwise.config import EngineConfig
from sectionwise.operators import layout, render, structure
from sectionwise.sources import registry
from sectionwise.store import Store
from sectionwise.streaming import ingest as stream


def test_store(spark, tmp_path):
    f = tmp_path / "in" / "a.md"
    f.parent.mkdir()
    f.write_text("# One\nhello power management\n## Two\nfoo_bar\n")
    store = Store(spark, str(tmp_path / "store"))
    ingest(spark, str(f), store, ["x", " x ", ""])
    assert [r["filename"] for r in store.documents().collect()] == ["a.md"]
    assert [r["tag"] for r in store.tags(1).collect()] == ["x"]
    assert [r["section_number"] for r in store.toc(1).collect()] == ["1", "1.1"]
    assert [r["title"] for r in store.search("foo_bar").collect()] == ["Two"]
    assert store.search("power-management").count() == 0
    assert store.search("power-management", tokenize=True).count() == 1
    assert store.search("_").count() == store.search("  ").count() == 0
    ingest(spark, str(f), store)  # the same name replaces, ids go on
    assert [r["id"] for r in store.documents().collect()] == [2]
    assert store.table("chunks").agg({"id": "min"}).first()[0] == 3
    with pytest.raises(KeyError):
        store.set_tags(1, ["y"])
    store.set_tags(2, ["b", "a", "a"])
    assert [r["tag"] for r in store.tags(2).collect()] == ["a", "b"]
    store.render()
    assert "## a" in (tmp_path / "store/output/global_catalog.md").read_text()
    catalog = (tmp_path / "store/output/global_catalog.md").read_text()
    links = re.findall(r"\]\(([^)]+)\)", catalog)
    assert links and all((tmp_path / "store/output" / x).exists() for x in links)
    index = tmp_path / "store/output/2/index.md"
    links = re.findall(r"\]\(([^)]+)\)", index.read_text())
    assert len(links) == 2 and all((index.parent / x).exists() for x in links)
    store.set_tags(2, ["z"])
    assert "## z" in (tmp_path / "store/output/global_catalog.md").read_text()
    assert store.delete(1) is None and store.delete(2) == "a.md"
    assert not index.parent.exists() and "## z" not in (tmp_path / "store/output/global_catalog.md").read_text()
    assert store.table("chunks").count() == store.table("tags").count() == 0


def test_index_and_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), EngineConfig(buckets=4))
    docs = spark.createDataFrame([(str(i), f"f{i:02}", ["t"]) for i in range(12)], "document_key string, filename string, tags array<string>")
    text = lambda i: f"alpha beta gamma {'delta' if i % 2 else 'beta alpha'}"
    chunks = spark.createDataFrame([(str(i), k, str(k), f"Title {i}", text(i + k), 1) for i in range(12) for k in range(3)], "document_key string, seg int, number string, title string, content string, page_start int")
    store.save(docs, chunks)
    want = sum("beta alpha" in text(i + k) for i in range(12) for k in range(3))
    assert store.search("beta_alpha").count() == want and store.search("alpha_beta delta").count() == 36 - want
    assert store.search("title_3").count() == 3 and store.search("gamma_title").count() == 0
    assert [r["document_id"] for r in store.search("alpha", document_id=5).collect()] == [5, 5, 5]
    assert store.search("alpha", limit=4).count() == 4 and store.search("alpha", limit=5000).count() == 36
    assert "bucket=1" in store.toc(5)._jdf.queryExecution().toString() or len(store._of("chunks", 5).inputFiles()) < len(store.table("chunks").inputFiles())
    store.delete(5)
    assert store.search("alpha").count() == 33 and store.index_counts() == {"postings": store.table("postings").count(), "indexed_chunks": 33, "chunks": 33}
    before = sorted(map(tuple, store.table("postings").select("term", "chunk_id", "col").collect()))
    store.rebuild_index()
    store.compact()
    assert sorted(map(tuple, store.table("postings").select("term", "chunk_id", "col").collect())) == before and not store.manifest()["folders"]["gone"]
    m = store.manifest()
    store.set_tags(6, ["x"])
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(m)


def test_docx_pictures_are_stored_and_linked(spark, tmp_path):
    w, a, r = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    pic = lambda i: f'<w:p><w:r><w:drawing><a:blip r:embed="{i}"/></w:drawing></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "p.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:a="{a}" xmlns:r="{r}"><w:body>{p("1 Start", "Title")}{pic("r1")}{p("text")}{pic("lost")}{pic("r2")}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="media/a.png"/><Relationship Id="r2" Target="/word/media/b.jpeg"/></Relationships>')
        z.writestr("word/media/a.png", b"\x89PNG one")
        z.writestr("word/media/b.jpeg", b"two")
    store = Store(spark, str(tmp_path / "s"))
    done = parse_file(spark, str(tmp_path / "p.docx"), store)
    assert done["document_id"] == 1 and done["filename"] == "p.docx" and done["chunk_count"] == done["chunks"].count() == 1
    out = tmp_path / "s/output/1"
    md = next((out / "chunks").glob("*_1_Start.md"))
    links = re.findall(r"!\[(.*?)\]\((.*?)\)", md.read_text())
    assert [c for c, _ in links] == ["Document Image 1", "Document Image 2"]
    assert [(md.parent / x).read_bytes() for _, x in links] == [b"\x89PNG one", b"two"]
    index = (out / "index.md").read_text()
    shown = re.findall(r"\]\((images/[^)]+)\)", index)
    assert len(shown) == 2 and all((out / x).exists() for x in shown)
    assert json.loads((out / "toc.json").read_text())[0]["images"] == shown


def test_pictures_that_are_not_there_stay_comments(spark):
    comment = '<!-- IMAGE: {"temp_path": "no.png", "caption": "x", "contained_text": []} -->'
    own = '<!-- IMAGE: {"temp_path": "yes.png", "caption": "Own", "contained_text": [{"text": "w1", "bbox": [0,0,1,1]}, {"text": "w2", "bbox": []}]} -->'
    chunks = spark.createDataFrame([(5, 1, "2.1", "T", f"a {comment} b {own} c <!-- IMAGE: {{bad}} -->", 3, "f")], "id long, document_id long, section_number string, title string, content string, page_start int, file_path string")
    images = spark.createDataFrame([(1, "yes.png", b"1"), (2, "no.png", b"2")], "document_id long, temp_path string, data binary")
    docs = spark.createDataFrame([(1, "d.pdf")], "id long, filename string")
    x = render.with_images(chunks, images)
    md = render.chunk_markdown(x, docs).first()["markdown"]
    assert f"a {comment} b \n![Own](../images/5_2.1_1.png)\n c <!-- IMAGE: {{bad}} -->" in md and "Own** (images/5_2.1_1.png)" in md and "w1, w2" in md
    assert [(r["rel_path"], bytes(r["data"])) for r in render.image_files(x, images).collect()] == [("images/5_2.1_1.png", b"1")]
    assert "  * [" not in render.index_page(x).first()["page"] and "images/5_2.1_1.png" in render.index_page(x).first()["page"]


def test_patterns_of_one_engine_only(spark):
    line = spark.createDataFrame([("abc",), ("draft 7",)], "line string")
    config = EngineConfig(extra_noise=("(?P<x>abc)", "(", r"^draft\s+\d++$"))
    assert [r["line"] for r in line.where(~structure.is_noise(line.line, config=config)).collect()] == ["abc"]


def test_captions_with_line_breaks_and_figure_boxes(spark):
    box = spark.createDataFrame([("d", 1, 0, 50.0, 100.0, 200.0, 200.0)], "document_key string, page int, box int, x0 double, y0 double, x1 double, y1 double")
    block = spark.createDataFrame([("d", 1, 50.0, 210.0, 200.0, 220.0, "\n Figure 3\nA plan \n", 0, 0)], "document_key string, page int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, block_type int")
    assert layout.captions(box, block).first()["caption"] == "Figure 3 A plan"
    rect = "x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
    drawn = spark.createDataFrame([(0.0, 100.0, 590.0, 102.0, 600.0, 800.0), (10.0, 100.0, 90.0, 180.0, 600.0, 800.0), (10.0, 10.0, 90.0, 30.0, 600.0, 800.0)], rect)
    pictures = spark.createDataFrame([(0.0, 100.0, 590.0, 102.0, 600.0, 800.0), (10.0, 790.0, 20.0, 799.0, 600.0, 800.0)], rect)
    assert sorted(r["x1"] for r in layout.figure_rects(drawn, pictures).collect()) == [90.0, 590.0]
    marks = spark.createDataFrame([("d", 0, " 1.2 Scope ", 4), ("d", 1, "Scope", 9), ("d", 2, "  ", 1)], "document_key string, ord int, title string, page int")
    assert sorted((r["title"], r["page"]) for r in layout.bookmark_titles(marks).collect()) == [("1.2 Scope", 4), ("Scope", 9)]


def test_html_lines_of_all_pages(spark):
    """Block by block, as a parser of events sees them."""
    import html.parser

    blocks = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "article", "section", "header", "footer", *(f"h{k}" for k in range(1, 7))}

    class Seen(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.now, self.skip = [], "", 0

        def cut(self):
            self.out += [" ".join(x.split()) for x in self.now.split("\n") if x.strip()]
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag == "body":
                self.out, self.now = [], ""
            self.skip += tag in ("script", "style", "nav", "template")
            if tag in blocks:
                self.cut()
            if re.fullmatch("h[1-6]", tag):
                self.now = "#" * int(tag[1]) + " "

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "nav", "template")
            if tag in blocks:
                self.cut()

        def handle_data(self, data):
            if not self.skip:
                self.now += data

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {}
    for r in registry.html_lines(pages).collect():
        got.setdefault(r["document_key"], []).append((r["line_no"], r["line"]))
    for r in pages.collect():
        p = Seen()
        p.feed(r["html"])
        p.cut()
        assert [x for _, x in sorted(got.get(str(r["page_id"]), []))] == p.out


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.md").write_text("# A\nb")
    store = Store(spark, str(tmp_path / "s"))
    stream.start(spark, str(tmp_path / "in"), store, str(tmp_path / "c")).awaitTermination(120)
    assert [r["filename"] for r in store.documents().collect()] == ["x.md"]


def test_docx_and_unknown():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Start", "Title")}{p("1.2")}{p("Scope")}{p("text")}</w:body></w:document>')
    assert [x for _, x in registry.reader_for(".DOCX")(b.getvalue())] == ["# Start", "1.2 Scope", "text"]
    with pytest.raises(ValueError, match="no reader"):
        registry.reader_for(".xyz")


def test_cli(spark, tmp_path):
    (tmp_path / "m.md").write_text("# A\nb")
    out = tmp_path / "o.json"
    assert cli.main(["--base-dir", str(tmp_path / "s"), "parse", "--file", str(tmp_path / "m.md"), "--output", str(out)]) == 0
    assert '"chunk_count": 1' in out.read_text()
    assert cli.main(["--base-dir", str(tmp_path / "s"), "get-chunk", "--chunk-id", "9", "--output", str(out)]) == 1
