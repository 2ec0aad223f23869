import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from versicle.sources import books, markup, timelines

OPF = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c1" href="text/one.xhtml" media-type="application/xhtml+xml"/>
<item id="c2" href="text/two.xhtml" media-type="application/xhtml+xml"/><item id="css" href="a.css" media-type="text/css"/>
<item id="toc" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="bad" href="broken.ncx" media-type="application/x-dtbncx+xml"/>
<item id="contents" href="contents.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest>
<spine><itemref idref="c2"/><itemref idref="none"/><itemref idref="css"/><itemref idref="c1"/></spine>
<guide><reference type="cover" href="text/two.xhtml"/></guide></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Part</text></navLabel><content src="text/two.xhtml"/>
<navPoint><navLabel><text>One</text></navLabel><content src="text/one.xhtml#x"/></navPoint></navPoint></navMap></ncx>"""
FILES = {
    "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/p.opf"/></rootfiles></container>',
    "EPUB/p.opf": OPF, "EPUB/toc.ncx": NCX, "EPUB/contents.xhtml": "<html><body><nav><a href='text/one.xhtml' epub:type='bodymatter'>Chapter One</a></nav></body></html>", "EPUB/broken.ncx": "<ncx",
    "EPUB/text/one.xhtml": "<html><body><h1>Head</h1><p>Mr. Fox ran. <em>Then</em> he sat!</p></body></html>",
    "EPUB/text/two.xhtml": "<html><head><title>Two</title></head><body><p>Only one</p></body></html>",
}


def container(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return out.getvalue()


def test_book(spark):
    df = spark.createDataFrame([("b", container(FILES))], "book_id string, content binary")
    chapters, sentences = books.parse_books(df)
    got = [(r["id"], r["title"], r["guide_type"], r["path"]) for r in chapters.orderBy("spine_pos").collect()]
    assert got == [("c2", "Part", "cover", "EPUB/text/two.xhtml"), ("c1", "Chapter One", "bodymatter", "EPUB/text/one.xhtml")]
    s = sentences.orderBy("element_id").collect()
    assert [(r["element_id"], r["text"]) for r in s] == [("mo_s_0001", "Only one"), ("mo_s_0002", "Head"), ("mo_s_0003", "Mr. Fox ran."), ("mo_s_0004", "Then he sat!")]
    assert all(r["block_text"][r["char_start"] : r["char_end"]] == r["text"] for r in s)


@pytest.mark.parametrize("name", ["../x", "a/../../x", "/etc/x", "C:\\x", "a\\..\\x"])
def test_unsafe_paths(name):
    with pytest.raises(books.UnsafePathError):
        books.entries_of(container({name: "x"}))


@pytest.mark.parametrize(
    "change, why",
    [({"META-INF/container.xml": None}, "no container descriptor"), ({"EPUB/p.opf": None}, "no package document"), ({"META-INF/container.xml": "<a/>"}, "names no package"), ({"EPUB/p.opf": "<a"}, "cannot be read")],
)
def test_package_faults(change, why):
    files = {k: v.encode() for k, v in {**FILES, **change}.items() if v is not None}
    with pytest.raises(books.BookError, match=why):
        books.spine_of(files)


def test_media_types_in_any_case():
    opf = OPF.replace("one.xhtml", "one.x").replace("application/xhtml+xml", "Application/XHTML+xml")
    assert [i for i, *_ in books.spine_of({**{k: v.encode() for k, v in FILES.items()}, "EPUB/p.opf": opf.encode()})] == ["c2", "c1"]


def test_faulty_containers_beside_good_ones(spark):
    rows = [("good", container({"a": "1", "b/": "", "c": "22"})), ("bad", b"no zip"), ("unsafe", container({"a": "1", "../x": "2"}))]
    got = books.unpack(spark.createDataFrame(rows, "book_id string, content binary"), faults=True).orderBy("book_id", "path").collect()
    assert [(r["book_id"], r["path"], r["content"] and bytes(r["content"]), (r["fault"] or "")[:6]) for r in got] == [
        ("bad", None, None, "not a "), ("good", "a", b"1", ""), ("good", "c", b"22", ""), ("unsafe", None, None, "unsafe"),
    ]


def test_not_a_container():
    with pytest.raises(books.BookError):
        books.entries_of(b"no zip")


def test_packed_container(spark):
    rows = [("b", n, c.encode()) for n, c in {"mimetype": "x", "EPUB/z.mp3": "a" * 99, "EPUB/a.xhtml": "b" * 99, ".hidden": "", "EPUB/x.tmp": "", "old.epub": ""}.items()]
    [r] = books.pack(spark.createDataFrame(rows, "book_id string, path string, content binary")).collect()
    with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
        assert [(i.filename, i.compress_type) for i in z.infolist()] == [("mimetype", 0), ("EPUB/a.xhtml", 8), ("EPUB/z.mp3", 0)]
        assert z.read("mimetype") == b"application/epub+zip"


def test_manifest_join(spark):
    refs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "x")], "k int, spine_pos int, idref string")
    items = spark.createDataFrame([(1, 0, "a", "old.html", "x"), (1, 1, "a", "new.html", "x"), (1, 2, "b", "s.css", "text/css")], "k int, item_pos int, id string, href string, media_type string")
    assert [r["href"] for r in books.join_manifest(refs, items, ["k"]).collect()] == ["new.html"]


def test_blocks():
    html = "<body><nav><p>skip</p></nav><div>a <p>b<br>c<p>d <b>e</b> f</div><!-- no --><ul><li>x<li>y</ul><div> </div></body>"
    assert [(t, x) for _, t, x in markup.blocks_of(html)] == [("div", "a "), ("p", "bc"), ("p", "d e f"), ("li", "x"), ("li", "y")]
    paths = [p for p, _, _ in markup.blocks_of(html)]
    assert len(set(paths)) == len(paths) and paths[1:3] == ["/body[1]/div[1]/p[1]", "/body[1]/div[1]/p[2]"]
    assert markup.blocks_of(None) == [] and markup.blocks_of("<p>" * 3000 + "deep")[-1][2] == "deep"


def test_segments_make_up_their_blocks():
    html = "<p>one <em>two <b>three</b></em> four</p><div>x<p>y</p>z</div>"
    by = {}
    for path, _, t in markup.segments_of(html):
        by[path] = by.get(path, "") + t
    assert by == {p: t for p, _, t in markup.blocks_of(html)}


def test_titles():
    assert markup.title_of("<h1>H</h1>", " Label ") == "Label"
    assert markup.title_of("<head><title>Untitled</title></head><body><p class='chapter-x'>C</p><h1>H</h1>") == "C"
    assert markup.title_of("<body><p>line\nnext</p>", None, " First. ") == "First." and markup.title_of("<body><p>line\nnext</p>") == "line" and markup.title_of(None) == ""


def test_title_has_references_that_end():
    head = "<head><script>a && b</script><title>{}</title></head>"
    titles = ["A&amp;&amp; B&amp", "&ampx; &lt &lt;", "&amp;lt; & &nosuch; &#38 &#38;", "R&D &copy 1"]
    assert [markup.title_of(head.format(t)) for t in titles] == ["A&& B&amp", "&ampx; &lt <", "&lt; & &nosuch; &#38 &", "R&D &copy 1"]
    assert markup.title_of("<body><h1>A&lt</h1>") == "A&lt" and markup.title_of("<body><p>a&amp\nb") == "a&amp"


def test_probe(spark):
    ticks = {"chapters": [{"start": 5000, "end": 15000, "time_base": "1/1000", "tags": {"title": "A"}}, {"start_time": "15.0", "end_time": "15.0"}]}
    rows = [("a", json.dumps(ticks)), ("b", json.dumps({"chapters": [], "format": {"duration": "42.5", "tags": {"title": "T"}}})), ("c", "{}")]
    got = sorted(map(tuple, timelines.probe_chapters(spark.createDataFrame(rows, "path string, json string"), "path", "json", 7.0).collect()))
    assert got == [("a", 0, "A", 5.0, 15.0), ("a", 1, "Chapter 2", 15.0, 15.0), ("b", 0, "T", 0.0, 42.5), ("c", 0, "Chapter 1", 0.0, 7.0)]
    chapters = spark.createDataFrame([("x/a.m4b", 0, "A", 5.0, 15.0), ("x/b.m4b", 0, "B", 1.0, 1.0)], "path string, chap_pos int, title string, start_s double, end_s double")
    units = timelines.audio_units(chapters, spark.createDataFrame([("x/a.m4b", 20.0), ("x/b.m4b", 9.0)], "path string, duration_s double"))
    assert sorted(map(tuple, units.collect())) == [("x/a.m4b", 0, 5.0, 15.0, "A"), ("x/b.m4b", 0, 0.0, 9.0, "b")]


def test_alignment_round_trip(spark, tmp_path):
    entry = {"element_id": "mo_s_0001", "text": "é", "start_ms": 31, "end_ms": 12.5, "confidence": 0.92857, "block_xpath": "/p", "char_start": 0, "char_end": 1}
    chapter = {"spine_item_id": "c1", "xhtml_filename": "a", "audio_filename": "b", "timeline": [entry, {"element_id": "x", "text": "t", "start_ms": 40, "end_ms": 50}]}
    (tmp_path / "one.json").write_text(json.dumps(chapter))
    rows = timelines.read_alignment(spark, str(tmp_path))
    got = rows.orderBy("pos").collect()
    assert [(r["end_ms"], r["confidence"], r["char_end"]) for r in got] == [(12, 0.92857, 1), (50, 1.0, 0)]
    [out] = timelines.alignment_json(rows, ["file"]).collect()
    back = json.loads(out["json"])
    assert back[0]["spine_item_id"] == "c1" and [e["confidence"] for e in back[0]["timeline"]] == [0.9286, 1.0]


def test_audio_formats(spark):
    rows = [(b"ID3xx", "a.x", None), (b"\xff\xfb90", "a", None), (b"\0\0\0\0ftypaaxc", "a", None), (b"\0\0\0\0ftypaax ", "a", None), (b"\0\0\0\0ftypM4B ", "a.mp3", None), (b"zz", "a.M4A", None), (b"", "a.AAX", None), (b"zz", "a.txt", None), (b"ID3", "a", "M4B ")]
    df = spark.createDataFrame(rows, "c binary, p string, b string")
    assert [r[0] for r in df.select(timelines.audio_format(F.col("c"), F.col("p"), F.col("b"))).collect()] == [".mp3", ".mp3", ".aaxc", ".aax", ".m4b", ".m4b", ".aax", None, ".m4b"]


def test_clean_document():
    out = books.clean_document('<html><head><META http-equiv="Content-Type" content="x"><meta charset="latin1"></head><body/></html>')
    assert out == '<html><head><meta charset="utf-8"/><title>Untitled</title></head><body/></html>'
