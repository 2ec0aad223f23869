import posixpath
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from versicle.functions.text import relative
from versicle.sources import books, markup, packages, rewrite

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/p.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:opf="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="u"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:creator opf:role="aut" opf:file-as="F">A</dc:creator><dc:identifier id="u">x</dc:identifier><meta name="cover" content="c"/><meta property="media:duration">00:00:09.000</meta></metadata>
<manifest><item id="c1" href="text/one.xhtml" media-type="application/xhtml+xml"/><item id="x" href="text/two_b.xhtml" media-type="application/xhtml+xml"/>
<item id="audio_two" href="a.css" media-type="text/css"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>
<spine toc="ncx"><itemref idref="c1"/><itemref idref="x"/></spine></package>"""
FILES = {
    "META-INF/container.xml": CONTAINER, "EPUB/p.opf": OPF, "EPUB/a.css": "p { margin: 0 }\n", "EPUB/titlepage.xhtml": "<html/>", "EPUB/audio/one.mp3": "a", "EPUB/audio/two.m4a": "b",
    "EPUB/toc.ncx": '<ncx><navMap><content src="gone.xhtml#a"/><content src=\'text/one.xhtml#b\'/></navMap></ncx>',
    "EPUB/text/one.xhtml": '<?xml version="1.0"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><body><h1 id="h">Head</h1><p>Mr. Fox <i>ran &amp; ran. Then</i> he sat!</p><svg/></body></html>',
    "EPUB/text/two_b.xhtml": "<html><body><p>Only one.</p></body></html>",
}


def entries(spark, files, book="b"):
    return spark.createDataFrame([(book, p, c.encode()) for p, c in files.items()], "book_id string, path string, content binary")


def chapters(spark, rows):
    return spark.createDataFrame(rows, "book_id string, chapter_pos int, spine_item_id string, xhtml_filename string, audio_filename string, pos int, element_id string, start_ms long, end_ms long")


ROWS = [
    ("b", 0, "c1", "one.xhtml", "one.mp3", 1, "mo_s_0001", 100, 900), ("b", 0, "c1", "one.xhtml", "one.mp3", 2, "mo_s_0002", 1000, 2500),
    ("b", 1, "", "text/two_b.xhtml", "audio/two.m4a", 1, "mo_s_0003", 0, 1500),
]


def items_of(opf):
    root = ElementTree.fromstring(opf)
    return root, {e.get("href"): e for e in root.iter() if str(e.tag).endswith("}item")}


def test_book_with_overlays(spark):
    e = entries(spark, {**FILES, "mimetype": "x"}).unionByName(entries(spark, {"a.txt": "t", "b.css": "p{}"}, "other"))
    spine, _ = books.parse_packages(e)
    lists = packages.chapter_playlists(e, chapters(spark, ROWS), spine)
    got = {r["chapter_pos"]: r for r in lists.collect()}
    assert (got[0]["smil_path"], got[0]["duration_ms"], got[0]["par_count"], got[0]["clock"]) == ("EPUB/text/one.smil", 2500, 2, "00:00:02.500")
    assert 'src="../audio/one.mp3" clipBegin="0.000s" clipEnd="1.000s"' in got[0]["smil"] and 'src="one.xhtml#mo_s_0001"' in got[0]["smil"]
    assert (got[1]["chapter_id"], got[1]["text_path"], got[1]["audio_path"]) == ("two_b", "EPUB/text/two_b.xhtml", "EPUB/audio/two.m4a")
    out = {(r["book_id"], r["path"]): bytes(r["content"]).decode() for r in packages.with_overlays(e, lists, "2020-01-01T00:00:00Z").collect()}
    assert out["other", "a.txt"] == "t" and out["other", "b.css"] == "p{}"
    assert "gone" not in out["b", "EPUB/toc.ncx"] and 'src="titlepage.xhtml"' in out["b", "EPUB/toc.ncx"] and "text/one.xhtml#b" in out["b", "EPUB/toc.ncx"]
    assert out["b", "EPUB/a.css"].startswith("p { margin: 0 }\n\n.-epub-media-overlay-active {")
    root, items = items_of(out["b", "EPUB/p.opf"])
    assert root.get("version") == "3.0" and "role" not in out["b", "EPUB/p.opf"] and "opf:" not in out["b", "EPUB/p.opf"]
    assert items["text/one.xhtml"].get("media-overlay") == "smil_c1" and items["text/two_b.xhtml"].get("media-overlay") == "smil_two_b"
    assert items["text/one.xhtml"].get("properties") == "svg" and items["nav.xhtml"].get("properties") == "nav"
    assert items["audio/two.m4a"].get("id") == "audio_two_1" and items["audio/two.m4a"].get("media-type") == "audio/mp4"
    metas = [(m.get("property"), m.get("refines"), m.text) for m in root.iter() if str(m.tag).endswith("}meta") and m.get("property")]
    assert metas == [("dcterms:modified", None, "2020-01-01T00:00:00Z"), ("media:duration", "#smil_c1", "00:00:02.500"), ("media:duration", "#smil_two_b", "00:00:01.500"), ("media:duration", None, "00:00:04.000"), ("media:active-class", None, "-epub-media-overlay-active")]
    folder = "EPUB"
    assert all(("b", posixpath.normpath(f"{folder}/{h}")) in out for h in items)


def test_update_twice_is_stable(spark):
    listing = [*FILES, "EPUB/text/one.smil"]
    lists = [{"chapter_id": "c1", "smil_path": "EPUB/text/one.smil", "text_path": "EPUB/text/one.xhtml", "audio_path": "one.mp3", "clock": "00:00:01.000"}]
    small = {k: v.encode() for k, v in FILES.items() if k.endswith((".opf", ".xml", ".ncx"))}
    once = packages.updated(small, listing, set(), lists, "00:00:01.000", "d")
    twice = packages.updated(small | once, [*listing, "EPUB/nav.xhtml"], set(), lists, "00:00:01.000", "d")
    assert once["EPUB/p.opf"] == twice["EPUB/p.opf"] and "EPUB/nav.xhtml" not in twice


def test_styles_made_where_there_are_none(spark):
    files = {p: c for p, c in FILES.items() if not p.endswith(".css")}
    e = entries(spark, files)
    out = {r["path"]: bytes(r["content"]).decode() for r in packages.with_overlays(e, packages.chapter_playlists(e, chapters(spark, ROWS)), "d").collect()}
    assert out["EPUB/styles.css"].startswith(".-epub-media-overlay-active {")


def test_missing_audio(spark):
    e = entries(spark, {p: c for p, c in FILES.items() if not p.endswith(".m4a")})
    with pytest.raises(Exception, match="no audio audio/two.m4a"):
        packages.chapter_playlists(e, chapters(spark, ROWS)).collect()


def test_no_manifest():
    with pytest.raises(books.BookError):
        packages.updated({"p.opf": b"<package><metadata/></package>"}, ["p.opf"], set(), [], "0", "d")


def test_spans():
    source = FILES["EPUB/text/one.xhtml"]
    (head, _, _), (path, _, text) = markup.blocks_of(source)[:2]
    cut = text.index(" Then")
    entries = [(head, "mo_s_0001", 0, 4), (path, "mo_s_0002", 0, cut), (path, "mo_s_0003", cut + 1, len(text))]
    new = rewrite.with_spans(source, entries, "more")
    assert '<h1 id="h"><span id="mo_s_0001">Head</span></h1>' in new
    assert '<p><span id="mo_s_0002">Mr. Fox </span><i><span class="more">ran &amp; ran.</span> <span id="mo_s_0003">Then</span></i><span class="more"> he sat!</span></p>' in new
    assert new.replace('<span class="more">', "").replace("</span>", "").replace('<span id="mo_s_0001">', "").replace('<span id="mo_s_0002">', "").replace('<span id="mo_s_0003">', "") == source


@pytest.mark.parametrize(
    "entries, why",
    [
        ([("/html[1]/p[1]", "a", 0, 1)], "no element"), ([("P", "a", 0, 999)], "bounds"), ([("P", "a", -1, 2)], "bounds"), ([("P", "a", 0, 5), ("P", "b", 3, 8)], "overlaps"),
        ([("P", "h", 0, 3)], "taken"), ([("P", "a", 2, 2)], "0 times"), ([("P", "a", 0, 1), ("P", "a", 2, 3)], "2 times"), ([(None, "a", 0, 1)], "no element"),
    ],
)
def test_spans_faults(entries, why):
    path = "/html[1]/body[1]/p[1]"
    with pytest.raises(rewrite.Fault, match=why):
        rewrite.with_spans(FILES["EPUB/text/one.xhtml"], [(path if p == "P" else p, *e) for p, *e in entries])


def test_spans_references():
    source = "<p>a&nbsp;b&#x41;c &lt;d&NotEqualTilde;e &copy f & g</p><p id='mo_s_9'/>"
    text = markup.blocks_of(source)[0][2]
    for i in range(len(text)):
        try:
            new = rewrite.with_spans(source, [("/p[1]", "s", i, i + 1)], allow_taken=True)
        except rewrite.Fault as e:
            assert "inside a character reference" in str(e)
        else:
            assert markup.blocks_of(new)[0][2] == text
    with pytest.raises(rewrite.Fault, match="mo_s_9 is taken"):
        rewrite.with_spans(source, [("/p[1]", "s", 0, 1)])


def test_rewrite(spark):
    docs = spark.createDataFrame([(1, "<p>One. Two.</p>"), (2, None), (3, "<p>x</p>"), (4, "<p>y</p>")], "id int, markup string")
    tl = spark.createDataFrame([(1, "/p[1]", "a", 0, 4), (1, "/p[1]", "b", 5, 9), (3, "/p[2]", "c", 0, 1), (2, "/p[1]", "d", 0, 1)], "id int, block_xpath string, element_id string, char_start int, char_end int")
    got = [tuple(r) for r in rewrite.rewrite(docs, tl, ["id"]).orderBy("id").collect()]
    assert got == [(1, '<p><span id="a">One.</span> <span id="b">Two.</span></p>', None), (2, None, None), (3, "<p>x</p>", "no element at /p[2]"), (4, "<p>y</p>", None)]


def test_relative(spark):
    rows = [("a/b/c.x", "a/b"), ("a/b/c.x", "a/d/e"), ("c.x", "a/b"), ("a/c.x", ""), ("a/b", "a/b"), ("a", "a/b"), ("a/c.x", "."), ("b", "a/b/c")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, f string").select(relative(F.col("p"), F.col("f"))).collect()]
    assert got == [posixpath.relpath(p, f or ".") for p, f in rows]
