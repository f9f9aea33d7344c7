"""Converters and renderers on files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import html
from textloom.plans import renderers
from textloom.sources import files, markdown, office
from textloom.sources.registry import FileTypes

PAGE = """<html><head><title> T </title><meta name="description" content="D"><meta property="og:description" content="no"><meta name="author" content="A"><style>x</style></head>
<body><nav>menu</nav><main><h1>Head <b>one</b></h1><p>It includes <b>bold</b> and <a href="/u">a link</a>.</p><!-- c --><ul><li>one</li><li>two <i>x</i></li></ul><ol><li>p</li></ol>
<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table><pre>x  y
 z</pre><br>after<hr>end<script>s()</script></main><footer>f</footer></body></html>"""


def test_html():
    text, meta = html.convert(PAGE)
    assert meta == {"title": "T", "description": "D", "keywords": None, "author": "A", "date": None}
    assert "# Head one" in text and "It includes bold and [a link](/u)." in text and "* one\n* two x" in text and "1. p" in text
    assert "| a | b\\|c |\n| --- | --- |\n| 1 |   |" in text and "x  y\n z" in text and "\n---\n" in text
    assert not any(x in text for x in ("menu", "s()", "f\n", "<!--"))
    old, _ = html.convert(PAGE, compat=True)
    assert "It includesboldand[a link](/u)." in old and "# Headone" in old
    assert html.convert("<p>a<p><b>c</p>d", links=False)[0] == "a\n\nc\n\nd"
    assert "v" in html.convert("<r><Title>t</Title><x/>v</r>", xml=True)[0]


def test_html_columns(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "i int, h string")
    rows = {r.i: r for r in html.html_to_markdown(df, "h").collect()}
    assert rows[1].metadata.title == "T" and rows[2].error == "no content" and rows[3].content == ""
    assert html.html_tables(df.limit(1), "h").first().tables == [[["a", "b|c"], ["1", ""]]]
    urls = ["https://a.b/c", "https://a.b/c.html?x=1", "https://a.b/c.pdf", "/x/y.XML", "/x/y.txt"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(html.is_html(F.col("u")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, True, False]


def test_markdown_source(spark):
    texts = ["---\ntitle: T\ndate: 2020-01-02\ntags: [a, b]\n---\n# H ##\nx\n#### H4 # Also", "---\n: bad: yaml: [\n---\nbody", "no front\n---\n", "---\nunclosed"]
    rows = markdown.read(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert rows[0].frontmatter == {"title": "T", "date": "2020-01-02", "tags": '["a", "b"]'} and [(h.level, h.text) for h in rows[0].headings] == [(1, "H"), (4, "H4 # Also")]
    assert rows[1].frontmatter is None and rows[1].content == "body" and rows[2].content == texts[2] and rows[3].content == texts[3]


def test_csv():
    data = 'name;age\n "a b" ; 3\n"x;y";4\n'
    assert files.csv_content("a, b\nc,d\n")[0] == "a b\nc d"
    assert files.csv_content(data, ";", header=False)[0].splitlines()[1] == "x;y 4"
    text, meta = files.csv_content("h\n1\n2\n3", max_rows=2)
    assert text == "h\n1" and (meta["truncated"], meta["original_rows"], meta["processed_rows"]) == (True, 3, 2)
    assert files.csv_content("")[0] == ""


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = f"<w:document {w}><w:body>{p('Intro', 'Heading1')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>{p('Text')}{p('item', 'ListBullet')}<w:sectPr/></w:body></w:document>"
    core = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>My T</dc:title><dc:creator>Me</dc:creator></cp:coreProperties>'
    return zipped({"word/document.xml": body, "docProps/core.xml": core})


def xlsx(rows=3, cols=2):
    x, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    name = lambda i: chr(65 + i)
    sheet = f"<worksheet {x}><sheetData>" + "".join(f'<row r="{i}">' + "".join(f'<c r="{name(j)}{i}" t="s"><v>{j % 2}</v></c>' if i == 1 else f'<c r="{name(j)}{i}"><v>{i * 10 + j}</v></c>' for j in range(cols)) + "</row>" for i in range(1, rows + 1)) + "</sheetData></worksheet>"
    return zipped({"xl/workbook.xml": f'<workbook {x} {r}><sheets><sheet name="S/1" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="u"><Relationship Id="r1" Type="a/worksheet" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {x}><si><t>h|1</t></si><si><t>h2</t></si></sst>"})


def pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sp = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    title = '<p:ph type="title"/>'
    rel = lambda i, t, to: f'<Relationship Id="{i}" Type="x/{t}" Target="{to}"/>'
    rels = lambda *r: f'<Relationships xmlns="u">{"".join(r)}</Relationships>'
    return zipped(
        {
            "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="a"/><p:sldId id="2" r:id="b"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": rels(rel("a", "slide", "slides/slide1.xml"), rel("b", "slide", "slides/slide2.xml")),
            "ppt/slides/slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{sp('Hello', title)}{sp('one')}{sp('two')}</p:spTree></p:cSld></p:sld>",
            "ppt/slides/slide2.xml": f"<p:sld {ns}><p:cSld><p:spTree>{sp('alone')}</p:spTree></p:cSld></p:sld>",
            "ppt/slides/_rels/slide1.xml.rels": rels(rel("n", "notesSlide", "../notesSlides/n1.xml")),
            "ppt/notesSlides/n1.xml": f"<p:notes {ns}><p:cSld><p:spTree>{sp('say this')}</p:spTree></p:cSld></p:notes>",
        }
    )


def test_office():
    text, meta = office.docx(docx(), "d.docx")
    assert text.startswith("# My T\n\n# Intro") and "* item" in text and text.endswith("### Table 1\n\n| a | b |\n| --- | --- |\n| 1 | 2 |")
    assert (meta["author"], meta["paragraph_count"], meta["table_count"]) == ("Me", 3, 1)
    text, meta = office.xlsx(xlsx())
    assert "## S_1" in text and "| h\\|1 | h2 |" in text and "| 30 | 31 |" in text and meta["sheets"]["S/1"] == {"row_count": 2, "column_count": 2}
    text, _ = office.xlsx(xlsx(6, 4), max_rows=2, max_cols=3)
    assert "| 40 |" not in text and "2 of 5 rows" in text and "3 of 4 columns" in text
    text, meta = office.pptx(pptx())
    assert text.startswith("## Slide 1: Hello\n\n* one\n* two\n\n**Notes:**\n\nsay this") and text.endswith("## Slide 2\n\nalone") and meta == {"slide_count": 2, "slides_with_notes": [1]}


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    for name, data in {"a.txt": b"one\r\ntwo", "sub/b.md": b"---\ntitle: T\n---\n# H\nbody", "c.csv": b"\xef\xbb\xbfx,y\n1,2", "d.html": PAGE.encode(), "e.docx": docx(), "f.xlsx": xlsx(), "g.pptx": pptx(), "h.pdf": b"%PDF-", "i.json": b"{}", "bad.txt": b"\xff\xfe\xfa", "empty.txt": b"", "broken.docx": b"no zip", "old.doc": b"x", "run.sh": b"x"}.items():
        (d / name).write_bytes(data)
    return str(d)


def test_load(spark, tree):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.load(spark, tree).collect()}
    assert len(rows) == 14
    assert rows["a.txt"].content == "one\ntwo" and rows["b.md"].content == "# H\nbody" and rows["b.md"].metadata.title == "T" and rows["b.md"].metadata.headings[0].text == "H"
    assert rows["c.csv"].content == "x y\n1 2" and rows["c.csv"].metadata.processed_rows == 2 and rows["d.html"].metadata.title == "T"
    assert rows["e.docx"].metadata.table_count == 1 and rows["f.xlsx"].metadata.sheets["S/1"].row_count == 2 and rows["g.pptx"].metadata.slides_with_notes == [1]
    errors = {k: r.error for k, r in rows.items() if r.error}
    assert set(errors) == {"h.pdf", "i.json", "bad.txt", "empty.txt", "broken.docx", "run.sh"}
    assert errors["i.json"] == "no converter for this type" and errors["bad.txt"] == "not UTF-8" and errors["run.sh"] == "dangerous extension" and "PDF" in errors["h.pdf"]
    assert files.load(spark, tree, recursive=False).count() == 13 and files.load(spark, tree, ["MD"]).count() == 1
    assert files.sample(files.scan(spark, tree), 3).select("path").collect() == files.sample(files.scan(spark, tree).repartition(5), 3).select("path").collect()
    assert files.csv_table(spark, tree + "/c.csv").count() == 2


def test_registry(spark):
    t = FileTypes()
    t.register("own", [".own"], lambda b: (b.decode().upper(), {}))
    with pytest.raises(TypeError):
        t.register("x", [".x"], None)
    t.register_extension("OWN", ["markdown"])
    t.register_format("rst", "rst")
    df = spark.createDataFrame([("/a.own", ".own", "a.own", "a", b"hi", 2, None)], "path string, ext string, name string, stem string, content binary, length long, modificationTime timestamp")
    assert files.convert(df, types=t).first().content == "HI"
    assert t.formats[".own"] == ["markdown"] and t.extensions["rst"] == "rst"


def test_plain_text():
    assert renderers.plain("# Head\n\nSome **bold** and *it* [l](u) `c`.\n\n- a\n- b\n\n> q\n\n---\n\n1. x") == "Head\n\nSome bold and it l c.\n\na\nb\n\nq\n\nx"
    assert renderers.plain("| a | b |\n|---|---|\n| 1 | 2 |") == "a b\n1 2"
    assert renderers.plain("```\nx = 1\n  y\n```\nafter") == "x = 1\n  y\n\nafter"
    assert renderers.plain_by_rules("### H\nText") == "H\n\nText" and renderers.plain_by_rules("* A\n+ B") == "A\n\nB"
    assert renderers.plain_by_rules("| H1 | H2 |\n|---|---|\n| c1 | c2 |") == "H1  H2\nc1  c2"


def test_tables():
    two = "| a | b |\n|---|---|\n| 1 | 2 |\n\ntext\n\n| c |\n|---|\n| 3 |\n"
    assert renderers.markdown_tables(two) == [[["a", "b"], ["1", "2"]], [["c"], ["3"]]]
    uneven = "| a | b |\n|---|---|\n| 1 |\n"
    assert renderers.markdown_tables(uneven) == [[["a", "b"], ["1", ""]]] and renderers.markdown_tables(uneven, strict=True) == []
    assert renderers.csv_text(two) == "a,b\r\n1,2\r\n" and renderers.csv_text("x\n\n y, z ") == 'Content\r\nx\r\n"y, z"\r\n'


def test_rendering_columns(spark, tmp_path):
    df = spark.createDataFrame([("t", "T", None, 1.5, 3, None, None, 12.345)], "c string, title string, author string, kb double, p int, s int, h int, r double")
    block = renderers.metadata_block(*(F.col(x) for x in ("title", "author", "kb", "p", "s", "h", "r")))
    got = df.select(renderers.markdown(F.col("c"), block).alias("m")).first().m
    assert got.startswith("t\n\n## Document Metadata\n\n- Title: T\n- File Size: 1.50 KB\n- Pages: 3\n- Token Reduction: 12.3")
    f = lambda e, p: df.select(renderers.output_format(F.lit(e).cast("string"), F.lit(p), "markdown").alias("x")).first().x
    assert [f("json", "a.md"), f(None, "a.txt"), f(None, "a"), f(None, "a.pdf")] == ["json", "plain_text", "markdown", "pdf"]
    with pytest.raises(ValueError):
        renderers.format_name("odd")
    assert renderers.format_name("TXT") == "plain_text"
    for fmt in ("json", "csv", "markdown"):
        renderers.write(df.select(F.col("c").alias("value")), str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 1
