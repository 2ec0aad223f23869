"""Packaged books: entries of containers, spine, navigation, chapters, and writing containers again."""

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, href_path
from ..operators.timeline import number_in_book
from . import markup

TEXT_TYPES = ("application/xhtml+xml", "text/html", "application/html+xml")


class BookError(ValueError):
    pass


class UnsafePathError(BookError):
    pass


def unsafe(path: str) -> bool:
    """Whether an entry would be written outside of the target folder."""
    p = path.replace("\\", "/")
    return p.startswith("/") or p[1:2] == ":" or ".." in p.split("/")


def entries_of(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Entries of a container, each read when it is asked for; all paths are checked before."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise BookError("not a container") from e
    if bad := next((n for n in z.namelist() if unsafe(n)), None):
        raise UnsafePathError(f"unsafe path in the container: {bad}")
    return ((n, z.read(n)) for n in z.namelist() if not n.endswith("/"))


#: Bytes of entries that a worker gathers before it hands them on.
BATCH = 32 << 20


def unpack(containers: DataFrame, key: str = "book_id", content: str = "content", faults: bool = False) -> DataFrame:
    """(key, path, content) of every entry. A container that cannot be opened or has an unsafe path fails the job; with
    `faults` it gives one row with the reason in a further column fault, and the others are unpacked."""
    kind = dict(containers.dtypes)[key]
    names = [key, "path", "content", "fault"][: 3 + faults]

    def rows(k, c):
        try:
            yield from ((k, n, e, None) for n, e in entries_of(c))
        except BookError as e:
            if not faults:
                raise
            yield k, None, None, str(e)

    def run(frames):
        for f in frames:
            out, size = [], 0
            for row in (r for k, c in zip(f[key], f[content]) for r in rows(k, c)):
                out.append(row[: len(names)])
                size += len(row[2] or b"")
                if size > BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    return containers.select(key, content).mapInPandas(run, f"{key} {kind}, path string, content binary" + ", fault string" * faults)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, content): containers by path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book_id"), "content")


def _local(tag) -> str:
    return str(tag).rpartition("}")[2]


def _find(root, name: str):
    return [e for e in root.iter() if _local(e.tag) == name]


def package_of(files: dict[str, bytes]) -> tuple[str, ElementTree.Element]:
    """(path, root) of the package document that the container's descriptor names first."""
    if "META-INF/container.xml" not in files:
        raise BookError("no container descriptor")
    try:
        named = [e.get("full-path") for e in _find(ElementTree.fromstring(files["META-INF/container.xml"]), "rootfile") if e.get("full-path")]
        if not named or named[0] not in files:
            raise BookError(f"no package document {named[0]}" if named else "the descriptor names no package document")
        return named[0], ElementTree.fromstring(files[named[0]])
    except ElementTree.ParseError as e:
        raise BookError(f"descriptor or package document cannot be read: {e}") from e


def _at(package: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(package), href))


def spine_of(files: dict[str, bytes]) -> list[tuple[str, str, str, str]]:
    """(id, href, media type, path) of the text items in reading order. Item references without a manifest item are
    left out, items without id or href are none; of items with one id the last counts."""
    package, root = package_of(files)
    items = {e.get("id"): (e.get("href"), e.get("media-type") or "") for e in _find(root, "item") if e.get("id") and e.get("href")}
    out = []
    for ref in (e.get("idref") for e in _find(root, "itemref")):
        if ref in items:
            href, kind = items[ref]
            if kind.lower() in TEXT_TYPES or href.lower().endswith((".xhtml", ".html")):
                out.append((ref, href, kind, _at(package, href)))
    return out


def package_path(files: dict[str, bytes]) -> str | None:
    """The package document that the container names, else the first of its kind."""
    if box := files.get("META-INF/container.xml"):
        for e in _find(ElementTree.fromstring(box), "rootfile"):
            if e.get("full-path") in files:
                return e.get("full-path")
    return min((p for p in files if p.endswith(".opf")), default=None, key=lambda p: (p.count("/"), p))


#: What tells a manifest item (media type, id, href, properties, all in lower case) to be a table of contents.
IS_NCX = lambda kind, i, href, words: "ncx" in kind or i == "ncx" or href.endswith(".ncx")
IS_NAV = lambda kind, i, href, words: "nav" in words or i == "nav" or href.endswith("nav.xhtml")


def contents_of(files: dict[str, bytes]) -> list[tuple[str, str]]:
    """('ncx' or 'nav', path) of the tables of contents that the manifest has: all NCX first."""
    package, root = package_of(files)
    facts = [(e.get("href"), [(e.get(a) or "").lower() for a in ("media-type", "id", "href", "properties")]) for e in _find(root, "item") if e.get("href")]
    return [(name, _at(package, href)) for name, test in (("ncx", IS_NCX), ("nav", IS_NAV)) for href, fact in facts if test(*fact)]


def guide_of(files: dict[str, bytes]) -> list[tuple[str, str, str]]:
    return [x for g in _find(package_of(files)[1], "guide") for e in g if _local(e.tag) == "reference" for x in _named(e.get("href"), e.get("type") or "", "guide")]


def _named(href: str | None, label: str, kind: str) -> list[tuple[str, str, str]]:
    """(target, label, kind) under a target's path and under its base name."""
    target = (href or "").split("#")[0].strip()
    return [(t, label.strip(), kind) for t in (target, posixpath.basename(target))] if target and label.strip() else []


def labels_of(kind: str, content: bytes) -> list[tuple[str, str, str]]:
    """(target, label, 'toc' or 'guide') of one table of contents, in order. A nested point has its own label and target
    only; links of a navigation document may bear a type. What can't be read has none."""
    out = []
    if kind == "ncx":
        try:
            points = _find(ElementTree.fromstring(content), "navPoint")
        except ElementTree.ParseError:
            return []
        for point in points:
            own = {_local(c.tag): c for c in point}
            label = " ".join("".join(own["navLabel"].itertext()).split()) if "navLabel" in own else ""
            out += _named(own["content"].get("src") if "content" in own else None, label, "toc")
        return out
    for node in markup.walk(markup.Tree(content.decode("utf-8", "replace")).root):
        if node.tag == "a" and any(n.tag == "nav" for n in _above(node)):
            href = node.attrs.get("href")
            out += _named(href, " ".join(markup.all_text(node).split()), "toc")
            out += _named(href, node.attrs.get("epub:type") or node.attrs.get("type") or "", "guide")
    return out


def _above(node):
    while node is not None:
        yield node
        node = node.parent


def parse_packages(entries: DataFrame, key: str = "book_id") -> tuple[DataFrame, DataFrame]:
    """(spine, nav) of each book from its entries. nav has (key, target, label, kind, seq): of what is named more than
    once the greatest seq counts; the guide comes first, then NCX, then navigation documents, as the manifest has them.
    Only package documents are gathered by book; tables of contents are read where they are."""
    kind = dict(entries.dtypes)[key]
    small = entries.filter((F.col("path") == "META-INF/container.xml") | F.lower("path").endswith(".opf"))

    def spine(k, f: pd.DataFrame) -> pd.DataFrame:
        rows = [(k[0], i, *r) for i, r in enumerate(spine_of(dict(zip(f["path"], f["content"]))))]
        return pd.DataFrame(rows, columns=[key, "spine_pos", "id", "href", "media_type", "path"])

    def named(k, f: pd.DataFrame) -> pd.DataFrame:
        files = dict(zip(f["path"], f["content"]))
        rows = [(k[0], None, None, *g, i) for i, g in enumerate(guide_of(files))]
        rows += [(k[0], path, how, None, None, None, (i + 1) << 32) for i, (how, path) in enumerate(contents_of(files))]
        return pd.DataFrame(rows, columns=[key, "path", "how", "target", "label", "kind", "seq"])

    def labels(frames):
        for f in frames:
            rows = [(k, *r, seq + i) for k, how, content, seq in zip(f[key], f["how"], f["content"], f["seq"]) for i, r in enumerate(labels_of(how, content))]
            yield pd.DataFrame(rows, columns=[key, "target", "label", "kind", "seq"])

    columns = f"{key} {kind}, target string, label string, kind string, seq long"
    found = small.groupBy(key).applyInPandas(named, f"{key} {kind}, path string, how string, target string, label string, kind string, seq long")
    tables = found.filter("how IS NOT NULL").select(key, "path", "how", "seq").join(entries.select(key, "path", "content"), [key, "path"])
    return (
        small.groupBy(key).applyInPandas(spine, f"{key} {kind}, spine_pos int, id string, href string, media_type string, path string"),
        found.filter("how IS NULL").select(key, "target", "label", "kind", "seq").unionByName(tables.select(key, "how", "content", "seq").mapInPandas(labels, columns)),
    )


def join_manifest(itemrefs: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Reading order joined to the manifest (keys, item_pos, id, href, media_type); of equal ids the last counts."""
    last = manifest.groupBy(*keys, "id").agg(F.max_by(F.struct("href", "media_type"), "item_pos").alias("m")).select(*keys, "id", "m.*")
    met = itemrefs.withColumnRenamed("idref", "id").join(last, [*keys, "id"])
    return met.filter(F.lower("media_type").isin(*TEXT_TYPES) | F.lower("href").rlike(r"\.x?html\z"))


def labelled(spine: DataFrame, nav: DataFrame, key: str = "book_id") -> DataFrame:
    """spine with label and guide_type, each by href, else by base name; empty labels count as none."""
    best = nav.groupBy(key, "target", "kind").agg(F.max_by("label", "seq").alias("l"))
    out = spine
    for kind, name in (("toc", "label"), ("guide", "guide_type")):
        for c, value in (("_a", href_path(F.col("href"))), ("_b", basename(href_path(F.col("href"))))):
            side = best.filter(F.col("kind") == kind).select(F.col(key).alias("_k"), F.col("target").alias("_t"), F.col("l").alias(c))
            out = out.withColumn("_v", value)
            out = out.join(side, (F.col(key) == F.col("_k")) & (F.col("_v") == F.col("_t")), "left").drop("_k", "_t", "_v")
        out = out.withColumn(name, F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")))).drop("_a", "_b")
    return out


def parse_books(containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, sentences) of containers (book_id, content): titles, blocks, sentences with ids over each book."""
    from ..functions.text import element_id, sentence_spans

    entries = unpack(containers)
    spine, nav = parse_packages(entries)
    texts = labelled(spine, nav).join(entries, ["book_id", "path"]).withColumn("html", F.decode("content", "UTF-8")).drop("content")
    keyed = texts.withColumn("_key", F.to_json(F.struct("book_id", "spine_pos")))
    blocks = markup.blocks(keyed, "_key", "html")
    blocks = blocks.select(F.get_json_object("_key", "$.book_id").alias("book_id"), F.get_json_object("_key", "$.spine_pos").cast("int").alias("spine_pos"), "block_pos", "block_xpath", "block_text")
    s = blocks.select("book_id", "spine_pos", "block_pos", "block_xpath", "block_text", F.posexplode(sentence_spans(F.col("block_text"))).alias("i", "s"))
    s = s.withColumn("sent_pos", F.col("block_pos").cast("long") * (1 << 20) + F.col("i"))
    s = number_in_book(s, ["book_id"], "spine_pos", "sent_pos")
    sentences = s.select("book_id", "spine_pos", "sent_pos", element_id(F.col("number")).alias("element_id"), "s.text", "block_xpath", F.col("s.start").alias("char_start"), F.col("s.stop").alias("char_end"), "block_text")
    first = sentences.groupBy("book_id", "spine_pos").agg(F.min_by("text", "sent_pos").alias("_first"))
    chapters = texts.join(first, ["book_id", "spine_pos"], "left").withColumn("title", markup.chapter_title("html", "label", "_first"))
    return chapters.select("book_id", "spine_pos", "id", "href", "media_type", "path", "title", "guide_type"), sentences


AUDIO = (".mp3", ".m4a", ".m4b", ".mp4", ".aac", ".ogg", ".oga", ".wav")


def left_out(path: str) -> bool:
    """Hidden and temporary files, and books within the book, are not packed."""
    name = path.rpartition("/")[2]
    return any(p.startswith(".") for p in path.split("/")) or name.endswith((".tmp", ".temp", "~", ".epub"))


def container_of(files: list[tuple[str, bytes]]) -> bytes:
    """A container: mimetype first and stored, audio stored, the rest deflated, by path."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put = lambda n, c, how: z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), c, how)
        put("mimetype", b"application/epub+zip", zipfile.ZIP_STORED)
        for name, content in sorted(files):
            if name != "mimetype" and not left_out(name):
                put(name, content, zipfile.ZIP_STORED if name.lower().endswith(AUDIO) else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pack(entries: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, content): one container for each book, which must fit in a worker's memory."""
    kind = dict(entries.dtypes)[key]

    def run(k, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [k[0]], "content": [container_of(list(zip(f["path"], f["content"])))]})

    return entries.select(key, "path", "content").groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")


def clean_document(html: str) -> str:
    """A document with one charset declaration, no http-equiv content type, and a title."""
    html = re.sub(r"<meta\b[^>]*http-equiv\s*=\s*[\"']?content-type[^>]*>", "", html, flags=re.I)
    html = re.sub(r"<meta\b[^>]*\bcharset\s*=[^>]*>", "", html, flags=re.I)
    title = "" if re.search(r"<title\b[^>]*>[^<]", html, re.I) else "<title>Untitled</title>"
    html = re.sub(r"<title\b[^>]*/>|<title\b[^>]*>\s*</title>", "", html, flags=re.I) if title else html
    return re.sub(r"(<head\b[^>]*>)", rf'\1<meta charset="utf-8"/>{title}', html, count=1, flags=re.I)
