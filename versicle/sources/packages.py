"""Media overlays in a packaged book: playlists written from chapters, and the package document, styles and navigation
brought in line with them. Only small files and paths are gathered by book; documents and audio stay where they are."""

import io
import posixpath
import re
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import hms_clock
from ..functions.text import AUDIO_MIME, basename, relative, stem
from ..operators import overlay, timeline
from .books import BookError, package_path

# Names and types of the format.
SMIL_TYPE, TEXT_TYPE, NCX_TYPE = "application/smil+xml", "application/xhtml+xml", "application/x-dtbncx+xml"
OLD_ATTRIBUTES = ("role", "file-as", "scheme")
OVERLAY_META = ("media:duration", "media:active-class")
ACTIVE = "-epub-media-overlay-active"


def _name(element) -> str:
    return str(element.tag).rpartition("}")[2]


def _words(element, attribute: str) -> list[str]:
    return (element.get(attribute) or "").split()


class Package:
    """A package document and the listing of its container."""

    def __init__(self, path: str, content: bytes, listing: Sequence[str]):
        self.path, self.folder, self.listing = path, posixpath.dirname(path), set(listing)
        for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(content), ["start-ns"]):
            if not re.fullmatch(r"ns\d+", prefix):
                ElementTree.register_namespace("" if prefix == "opf" else prefix, uri)
        self.root = ElementTree.parse(io.BytesIO(content), ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True))).getroot()
        self.space = self.root.tag.rpartition("}")[0] + "}" if "}" in self.root.tag else ""
        self.metadata, self.manifest = (self._part(n) for n in ("metadata", "manifest"))

    def _part(self, name: str):
        found = next((e for e in self.root.iter() if _name(e) == name), None)
        if found is None:
            raise BookError(f"no {name} in {self.path}")
        return found

    def href(self, path: str) -> str:
        return posixpath.relpath(path, self.folder or ".")

    def file(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(self.folder, href))

    def items(self) -> list:
        return [e for e in self.manifest if _name(e) == "item"]

    def registered(self, path: str, base: str, media_type: str):
        """The item of a file with its media type, made under a free id if there is none."""
        href, items = self.href(path), self.items()
        item = next((i for i in items if i.get("href") == href), None)
        if item is None:
            taken, new, k = {i.get("id") for i in items}, base, 0
            while new in taken:
                k += 1
                new = f"{base}_{k}"
            item = ElementTree.SubElement(self.manifest, f"{self.space}item", {"id": new, "href": href})
        item.set("media-type", media_type)
        return item

    def meta(self, text: str, **attributes: str) -> None:
        ElementTree.SubElement(self.metadata, f"{self.space}meta", attributes).text = text

    def modernise(self, modified: str) -> None:
        """Version 3.0, no attributes of older versions on metadata, one date of change."""
        self.root.set("version", "3.0")
        for e in self.metadata.iter():
            for a in [a for a in e.attrib if a.endswith(OLD_ATTRIBUTES)]:
                del e.attrib[a]
        self.forget("dcterms:modified")
        self.meta(modified, property="dcterms:modified")

    def forget(self, *properties: str) -> None:
        for e in [e for e in self.metadata if _name(e) == "meta" and e.get("property") in properties]:
            self.metadata.remove(e)

    def give(self, item, word: str) -> None:
        if word not in _words(item, "properties"):
            item.set("properties", " ".join([*_words(item, "properties"), word]))

    def navigation(self) -> tuple[str, bytes] | None:
        """A navigation document from the reading order, where the book has none."""
        if any("nav" in _words(i, "properties") for i in self.items()):
            return None
        by_id = {i.get("id"): i.get("href") or "" for i in self.items()}
        order = [h for e in self.root.iter() if _name(e) == "itemref" and (h := by_id.get(e.get("idref")))]
        path = posixpath.join(self.folder, "nav.xhtml")
        label = lambda h: posixpath.splitext(posixpath.basename(h))[0].replace("_", " ").title()
        base = "nav_doc" if "nav" in by_id else "nav"
        self.give(self.registered(path, base, TEXT_TYPE), "nav")
        return path, overlay.nav_document([(h, label(h)) for h in order]).encode()

    def text_item(self, chapter_id: str, text_path: str | None, smil_path: str):
        """The item that a playlist reads: by id, by path, or by the stem of its name."""
        items = self.items()
        stem_of = lambda p: posixpath.splitext(posixpath.basename(p))[0]
        is_text = lambda i: "xhtml" in (i.get("media-type") or "") or (i.get("href") or "").endswith((".xhtml", ".html"))
        tests = (
            lambda i: i.get("id") == chapter_id and is_text(i),
            lambda i: text_path is not None and i.get("href") == self.href(text_path),
            lambda i: is_text(i) and stem_of(i.get("href") or "") in (chapter_id, stem_of(smil_path)),
        )
        return next((i for test in tests for i in items if test(i)), None)

    def written(self) -> bytes:
        return b'<?xml version="1.0" encoding="utf-8"?>\n' + ElementTree.tostring(self.root, encoding="utf-8")


def repaired_ncx(ncx: bytes, folder: str, listing: set[str], instead: str = "titlepage.xhtml") -> bytes:
    """Links to files that the book lacks lead to its title page, if it has one."""
    if posixpath.join(folder, instead) not in listing:
        return ncx

    def mend(m: re.Match) -> str:
        target = m[2].split("#")[0]
        dead = target and posixpath.normpath(posixpath.join(folder, target)) not in listing
        return f"src={m[1]}{instead}{m[1]}" if dead else m[0]

    return re.sub(r"""src=(["'])(.*?)\1""", mend, ncx.decode("utf-8", "replace")).encode()


def updated(files: dict[str, bytes], listing: Sequence[str], with_svg: set[str], playlists: Sequence[dict], total: str, modified: str, active: str = ACTIVE) -> dict[str, bytes]:
    """The files of a book that change: its package document, and where needed navigation and NCX.

    playlists: dicts of chapter_id, smil_path, text_path, audio_path and clock, in order.
    """
    path = package_path(files)
    if path is None:
        raise BookError("no package document")
    p, out = Package(path, files[path], listing), {}
    p.modernise(modified)
    if nav := p.navigation():
        out[nav[0]] = nav[1]
        p.listing.add(nav[0])
    ids = []
    for x in playlists:
        smil = p.registered(x["smil_path"], f"smil_{x['chapter_id']}", SMIL_TYPE)
        ids.append(smil.get("id"))
        if (text := p.text_item(x["chapter_id"], x["text_path"], x["smil_path"])) is not None:
            text.set("media-overlay", smil.get("id"))
    for audio in audio_files(p.folder, listing, [x["audio_path"] for x in playlists]):
        name, kind = posixpath.splitext(posixpath.basename(audio))
        p.registered(audio, "audio_" + re.sub(r"[^A-Za-z0-9_-]", "_", name), AUDIO_MIME.get(kind.lower(), "audio/mpeg"))
    p.forget(*OVERLAY_META)
    for i, x in zip(ids, playlists):
        p.meta(x["clock"], property="media:duration", refines=f"#{i}")
    p.meta(total, property="media:duration")
    p.meta(active, property="media:active-class")
    for i in p.items():
        if p.file(i.get("href") or "") in with_svg:
            p.give(i, "svg")
        if i.get("media-type") == NCX_TYPE and (ncx := p.file(i.get("href") or "")) in files:
            out[ncx] = repaired_ncx(files[ncx], posixpath.dirname(path), p.listing)
    out[path] = p.written()
    return out


def audio_files(folder: str, listing: Sequence[str], named: Sequence[str | None]) -> list[str]:
    """Audio to register, each file once: what playlists name, then what lies in the audio folders. A name that is not
    in the book counts by its base name in those folders, or not at all."""
    have = set(listing)
    folders = [posixpath.join(folder, "audio"), "audio"]
    found = [next((c for c in (n, *(posixpath.join(d, posixpath.basename(n)) for d in folders)) if c in have), None) for n in named if n]
    lying = [f for d in folders for f in sorted(have) if posixpath.dirname(f) == d and posixpath.splitext(f)[1].lower() in AUDIO_MIME]
    return list(dict.fromkeys(f for f in (*found, *lying) if f))


def chapter_playlists(entries: DataFrame, chapters: DataFrame, spine: DataFrame | None = None, key: str = "book_id", continuous: bool = True) -> DataFrame:
    """(key, chapter_pos, chapter_id, smil_path, text_path, audio_path, duration_ms, par_count, clock, smil) of chapters
    (key, chapter_pos, spine_item_id, xhtml_filename, audio_filename, pos, element_id, start_ms, end_ms).

    Texts are found by their path, their id or name in the reading order (spine: key, id, href, path), or by name among
    the entries; audio by path or name. A chapter whose text or audio is missing is an error.
    """
    keys = [key, "chapter_pos"]
    heads = chapters.groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("spine_item_id", "xhtml_filename", "audio_filename")))
    files = entries.select(key, "path")
    texts = overlay.resolve(heads.select(key, F.col("xhtml_filename").alias("name")).distinct(), files, [key]).select(key, F.col("name").alias("xhtml_filename"), F.col("path").alias("_file"))
    audio = overlay.resolve(heads.select(key, F.col("audio_filename").alias("name")).distinct(), files, [key]).select(key, F.col("name").alias("audio_filename"), F.col("path").alias("audio_path"))
    heads = heads.join(texts, [key, "xhtml_filename"], "left").join(audio, [key, "audio_filename"], "left")
    by_spine = F.lit(None).cast("string")
    if spine is not None:
        s = spine.select(F.col(key).alias("_k"), "id", "href", F.col("path").alias("_path"), "spine_pos")
        same = (F.col(key) == F.col("_k")) & ((F.col("id") == F.col("spine_item_id")) | (F.col("href") == F.col("xhtml_filename")) | (basename(F.col("href")) == F.col("xhtml_filename")))
        first = heads.join(s, same).groupBy(*keys).agg(F.min_by("_path", "spine_pos").alias("_spine"))
        heads, by_spine = heads.join(first, keys, "left"), F.col("_spine")
    path = F.when(F.col("_file") == F.col("xhtml_filename"), F.col("_file")).otherwise(F.coalesce(by_spine, "_file"))
    missing = lambda what, name: F.raise_error(F.concat(F.lit(f"no {what} "), name, F.lit(" in the book")))
    heads = heads.select(
        *keys, F.coalesce(F.nullif("spine_item_id", F.lit("")), stem(path)).alias("chapter_id"), F.coalesce(path, missing("text", F.col("xhtml_filename"))).alias("text_path"),
        F.coalesce(F.col("audio_path"), missing("audio", F.col("audio_filename"))).alias("audio_path"),
    )
    folder = F.regexp_extract("text_path", r"^(.*)/[^/]*\z", 1)
    heads = heads.withColumn("smil_path", F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), stem(F.col("text_path")), F.lit(".smil")))
    heads = heads.withColumn("text_ref", basename(F.col("text_path"))).withColumn("audio_src", relative(F.col("audio_path"), folder))
    clips = timeline.clips(chapters, keys, continuous=continuous).select(*keys, "pos", "par_id", "clip_start", "clip_end", "element_id")
    ends = clips.groupBy(*keys).agg(F.max("clip_end").alias("duration_ms"), F.count(F.lit(1)).alias("par_count"))
    smil = overlay.playlist(clips.join(heads.select(*keys, "text_ref", "audio_src"), keys), keys)
    return heads.drop("text_ref", "audio_src").join(ends, keys).withColumn("clock", hms_clock(F.col("duration_ms"))).join(smil, keys)


def _small(path: Column) -> Column:
    return F.lower(path).rlike(r"(container\.xml|\.opf|\.ncx)\z")


def with_overlays(entries: DataFrame, playlists: DataFrame, modified: str, key: str = "book_id", active: str = ACTIVE, color: str = overlay.HIGHLIGHT) -> DataFrame:
    """entries (key, path, content) of books with their playlists (as chapter_playlists gives them) added: package
    documents updated, styles for the active class, NCX mended, navigation made where it lacks. `modified` is the date of
    change. Books without playlists stay as they are."""
    kind = dict(entries.dtypes)[key]
    ours = entries.join(playlists.select(key).distinct(), key, "left_semi")
    smil = playlists.select(key, F.col("smil_path").alias("path"), F.encode("smil", "UTF-8").alias("content"))
    is_text = F.lower("path").rlike(r"\.x?html\z")
    svg = is_text & F.contains(F.lower(F.decode("content", "UTF-8")), F.lit("<svg"))
    seen = ours.select(key, "path", F.when(_small(F.col("path")), F.col("content")).alias("content"), F.coalesce(svg, F.lit(False)).alias("svg"))
    seen = seen.unionByName(smil.select(key, "path", F.lit(None).cast("binary").alias("content"), F.lit(False).alias("svg")))
    fields = ["chapter_pos", "chapter_id", "smil_path", "text_path", "audio_path", "clock"]
    total = playlists.groupBy(F.col(key).alias("_k")).agg(hms_clock(F.sum("duration_ms")).alias("total"))
    lists = playlists.join(total, F.col(key) == F.col("_k")).select(key, *fields, "total")

    def run(k, files: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        small = {p: bytes(c) for p, c in zip(files["path"], files["content"]) if c is not None}
        rows = lists.sort_values("chapter_pos")[fields].to_dict("records")
        new = updated(small, list(files["path"]), set(files["path"][files["svg"]]), rows, lists["total"].iloc[0], modified, active)
        content_folder = posixpath.dirname(package_path(small))
        if not any(p.endswith(".css") for p in files["path"]):
            new[posixpath.join(content_folder, "styles.css")] = b""
        return pd.DataFrame([(k[0], p, c) for p, c in new.items()], columns=[key, "path", "content"])

    changed = seen.groupBy(key).cogroup(lists.groupBy(key)).applyInPandas(run, f"`{key}` {kind}, path string, content binary")
    new = changed.unionByName(smil)
    made = entries.select(key, "path", "content").join(new.select(key, "path"), [key, "path"], "left_anti").unionByName(new)
    styled = F.encode(overlay.active_style(F.decode("content", "UTF-8"), active, color), "UTF-8")
    owners = playlists.select(key).distinct().withColumn("_ours", F.lit(True))
    return made.join(owners, key, "left").select(key, "path", F.when(F.col("_ours") & F.col("path").endswith(".css"), styled).otherwise(F.col("content")).alias("content"))
