"""Exact removal of repeated byte strings by column-wise suffix sorting of a collection of documents.

Inserting one symbol of every document each round takes as many rounds as the longest text has bytes, each over all
that is sorted so far. So the collection that is sorted is not that of whole texts but of all segments in which a
repeat can lie: every window of `width` bytes has an anchor, its least k-gram by hash; windows that are equal have equal
anchors at equal offsets; a run of windows with one anchor is a segment of at most 2 * width - k bytes. Segments whose
anchor occurs once hold no repeat. Equal segments are one class, of which all but the first occurrence are repeats.
Classes that share an anchor are sorted together in bounded collections: each round prepends one symbol to every
segment, finds its place from the Burrows-Wheeler transform so far and updates transform and common prefixes in one
sequential pass. Windows are equal where the common prefix is `width` or more.

Anchors with more than `most` classes are not put into one collection. Their segments are parted by the side on which a
window reaches half of what it has besides the anchor, and dealt by that half; a half that occurs once holds no repeat.
Where more than `most` parts share a half, their windows are compared by hash, with partial aggregates. The result is the same.

Hashes are 64 bits; windows on the latter way carry two.

Defined cases. Null or empty text, or one shorter than `width`: nothing is removed. Null doc_id: the row takes no part
and stays whole. Rows that repeat both doc_id and text are one document and give the same result. Rows that repeat a
doc_id with different texts are documents each, in the order of a hash of the text. An empty table gives an empty
result; further columns are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .shingle_join import _U, _mix

WIDTH, GRAM = 100, 32
#: Classes of one anchor that are sorted in one collection; classes in a collection, about.
MOST_CLASSES, COLLECTION = 1024, 8192
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0xD1B54A32D192ED03
_CHUNK = 1 << 19


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for every full window."""
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.r_[x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)].reshape(-1, width)
    head = np.minimum.accumulate(rows, 1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


class Hasher:
    """Hashes of substrings of one chunk of bytes, wherever they stand in it."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        self.sums = np.r_[_U(0), np.cumsum(_TABLE[data] * _powers(n, base), dtype=np.uint64)]
        self.inverse = _powers(n + 1, pow(base, -1, 1 << 64))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def anchors(data: np.ndarray, edge: np.ndarray, width: int, gram: int):
    """For texts that follow one another in data, text d from edge[d] to edge[d + 1]: (d, first window, windows, offset of
    the anchor in the first window, anchor hash, segment hash) of every segment. At most 2^20 bytes."""
    span = width - gram + 1
    if len(data) < width:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    hasher = Hasher(data)
    at = np.arange(len(data) - gram + 1)
    h = hasher.of(at, at + gram)
    # ordered by hash, then leftmost
    least = _slide_min((h >> _U(20) << _U(20)) | at.astype(np.uint64), span)
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    inside = np.flatnonzero(doc[: len(least)] == doc[width - 1 : width - 1 + len(least)])
    pos = (least[inside] & _U((1 << 20) - 1)).astype(np.int64)
    new = np.r_[True, (np.diff(pos) != 0) | (np.diff(inside) != 1)] if len(pos) else np.empty(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(pos)])
    a, p = inside[first], pos[first]
    seg = hasher.of(a, a + count + width - 1)
    seg = _mix(seg + (p - a).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    d = doc[a]
    return d, a - edge[d], count, p - a, h[p], seg


def _texts(rows: list[bytes], width: int):
    """Chunks (row numbers, offsets in the row, data, edges) of at most _CHUNK windows; long texts are cut with an overlap."""
    held, size = [], 0
    for r, text in enumerate(rows):
        for off in range(0, max(1, len(text) - width + 1), _CHUNK):
            part = text[off : off + _CHUNK + width - 1]
            if len(part) < width:
                continue
            if held and size + len(part) > _CHUNK + width:
                yield held
                held, size = [], 0
            held.append((r, off, part))
            size += len(part)
    if held:
        yield held


def occurrences(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(h, s, doc, g, place): segments by anchor hash and segment hash; g tells texts of one doc_id apart, place packs first
    window, windows, anchor offset."""

    def run(batches):
        for b in batches:
            ids, tags = (b.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("doc_id", "g"))
            for held in _texts([(t or "").encode() for t in b.column("text").to_pylist()], width):
                edge = np.cumsum([0, *(len(p) for _, _, p in held)])
                d, a, n, off, h, s = anchors(np.frombuffer(b"".join(p for _, _, p in held), np.uint8), edge, width, gram)
                row, base = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
                place = ((a + base[d]) << 16) | (n << 8) | off
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), s.view(np.int64), ids[row[d]], tags[row[d]], place)], names=["h", "s", "doc", "g", "place"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "g", "text").mapInArrow(run, "h long, s long, doc long, g long, place long")


def sort_collection(segments: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction: (segment, suffix length, common prefix with the one before) of all sorted suffixes.

    Suffixes end with a terminator below all symbols; equal ones are in the order of their segments. Common prefixes
    are exact up to `width`, then only said to be at least that.
    """
    m = len(segments)
    size = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    start = np.cumsum(size) - size
    present = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.uint8)
    code[present] = np.arange(1, len(present) + 1)  # 0 is the terminator
    data = np.r_[code[data], np.uint8(0)]
    before = lambda x, length: np.where(size[x] > length, data[start[x] + np.maximum(size[x] - length - 1, 0)], 0).astype(np.uint8)
    sid, length = np.arange(m, dtype=np.int32), np.zeros(m, np.uint8)
    bwt, lcp = before(np.arange(m), 0), np.zeros(m, np.uint8)
    fresh = np.arange(m)  # places of the suffixes that the last round put in
    for j in range(1, int(size.max(initial=0)) + 1):
        fresh = fresh[bwt[fresh] > 0]
        if not len(fresh):
            break
        # symbols of the transform in stable order: place i of it is place i of the sorted suffixes, terminators first
        order = np.argsort(bwt, kind="stable")
        ends = len(bwt) - int(np.count_nonzero(bwt))
        order = order[ends:]
        is_new = np.zeros(len(bwt), bool)
        is_new[fresh] = True
        new_at = np.flatnonzero(is_new[order]) + m
        n = m + len(order)
        new = np.zeros(n, bool)
        new[new_at] = True
        merged = []
        tails = order[new_at - m]
        for old, values in ((sid, sid[tails]), (length, np.full(len(tails), j, np.uint8)), (bwt, before(sid[tails], j)), (lcp, np.zeros(len(tails), np.uint8))):
            out = np.empty(n, old.dtype)
            out[new] = values
            out[~new] = old
            merged.append(out)
        # common prefixes change at what is new and at what follows it: one more than the least between the two tails
        touched = np.unique(np.r_[new_at, new_at[new_at + 1 < n] + 1])
        t = touched - m
        same = np.zeros(len(t), bool)
        same[t > 0] = bwt[order[t[t > 0]]] == bwt[order[t[t > 0] - 1]]
        merged[3][touched] = 0
        if same.any():
            lo, hi = order[t[same] - 1] + 1, order[t[same]] + 1
            between = np.minimum.reduceat(np.r_[lcp, np.uint8(0)], np.stack([lo, hi], 1).ravel())[::2]
            merged[3][touched[same]] = np.minimum(between + 1, width)
        sid, length, bwt, lcp = merged
        fresh = new_at
    return sid, length, lcp


def repeated_windows(segments: list[bytes], doc: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of the windows of which an equal one has a lesser (doc, first + offset). What stands at one place
    is one window, however many segments have it."""
    sid, length, lcp = sort_collection(segments, width)
    size = np.array([len(s) for s in segments], np.int64)
    whole = length >= width
    group = np.cumsum(lcp < width)[whole]
    sid = sid[whole].astype(np.int64)
    off = size[sid] - length[whole]
    place = first[sid] + off
    by = np.lexsort((place, doc[sid], group))
    new = np.r_[True, np.diff(group[by]) != 0] if len(by) else np.empty(0, bool)
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    gone = by[(doc[sid[by]] != doc[sid[head]]) | (place[by] != place[head])]
    return sid[gone], off[gone]


def may_share(keys: list[int], segments: list[bytes], off: list[int], width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Segments that can share a window with another of the same anchor. A shared window reaches at least half of what
    it has besides the anchor to the left or to the right of it, so one of these halves must be shared."""
    half = (width - gram) // 2
    ends = {}
    sides = []
    for k, s, p in zip(keys, segments, off):
        left = (k, 0, s[p - half : p]) if p >= half else None
        right = (k, 1, s[p + gram : p + gram + half]) if len(s) >= p + gram + half else None
        sides.append((left, right))
        for e in (left, right):
            if e:
                ends[e] = ends.get(e, 0) + 1
    return np.array([any(e and ends[e] > 1 for e in both) for both in sides], bool)


def halves(batches, width: int = WIDTH, gram: int = GRAM):
    """Rows (key, o, h, s, doc, g, a, p, seg) of segments (h, s, doc, g, a, p, seg): the windows that reach half of what they
    have besides the anchor to its left, and the others, which reach as much to its right. Windows that are equal are in
    parts with the same half, and so with the same key. o is where a part begins in its segment."""
    half = (width - gram) // 2
    for b in batches:
        out = []
        for h, s, doc, g, a, p, seg in zip(*(b.column(c).to_pylist() for c in ("h", "s", "doc", "g", "a", "p", "seg"))):
            cut = max(0, p - half + 1)  # the first window that does not reach as far to the left
            for o, part, side, at in ((0, seg[: cut + width - 1], b"l", p - half), (cut, seg[cut:], b"r", p + gram)):
                if len(part) >= width and (side == b"r" or cut):
                    key = xxhash.xxh3_64_intdigest(seg[at : at + half] + side + h.to_bytes(8, "little", signed=True))
                    out.append((key - (1 << 64) if key >> 63 else key, o, h, s, doc, g, a + o, p - o, part))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())], names=["key", "o", "h", "s", "doc", "g", "a", "p", "seg"])


def _bytes_of(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(doc_id, g, z) with the compressed texts, and (_doc, _g, name) of wanted (doc, g, name)."""

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [None if t is None else c.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("g"), pa.array(z, pa.binary())], names=["doc_id", "g", "z"])

    packed = docs.select("doc_id", "g", "text").mapInArrow(squeeze, "doc_id long, g long, z binary")
    return packed, wanted.select(F.col("doc").alias("_doc"), F.col("g").alias("_g"), name)


def _unpack(z: bytes | None) -> bytes:
    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST_CLASSES) -> DataFrame:
    """(doc, g, spans array<long>): runs of repeated windows in each text, packed as first window << 8 | windows."""
    found = occurrences(docs, width, gram).repartition("h")
    # a value of all columns, so that none is pruned before the exchange and the count reads the one the join reads
    rest = F.bit_xor(F.xxhash64("s", "doc", "g", "place")).alias("rest")
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), rest).filter("n > 1 AND rest IS NOT NULL").select("h")
    found = stored(found.hint("merge").join(counts.hint("merge"), "h"))
    classes = found.groupBy("h", "s").agg(F.min(F.struct("doc", "g", "place")).alias("first"))
    classes = stored(classes.select("h", "s", "first.doc", "first.g", "first.place"))
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    wanted = classes.hint("merge").join(several.hint("merge"), "h")
    by_doc = wanted.groupBy("doc", "g").agg(F.collect_list(F.struct("h", "s", "place", "k")).alias("w"))
    packed, by_doc = _bytes_of(docs, by_doc, "w")
    joined = packed.join(by_doc, (F.col("doc_id") == F.col("_doc")) & (F.col("g") == F.col("_g"))).select("doc_id", "g", "z", "w")

    def cut_out(batches):
        for b in batches:
            out = []
            for doc, g, z, ws in zip(*(b.column(c).to_pylist() for c in ("doc_id", "g", "z", "w"))):
                text = _unpack(z)
                for w in ws:
                    a, n = w["place"] >> 16, w["place"] >> 8 & 255
                    out.append((w["h"], w["s"], doc, g, a, w["k"], w["place"] & 255, text[a : a + n + width - 1]))
                if len(out) >= 8192:
                    yield _segments(out)
                    out = []
            yield _segments(out)

    segments = stored(joined.mapInArrow(cut_out, "h long, s long, doc long, g long, a long, k long, p long, seg binary"))
    halved = segments.filter(F.col("k") > most).mapInArrow(lambda batches: halves(batches, width, gram), "key long, o long, h long, s long, doc long, g long, a long, p long, seg binary")
    sizes = halved.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    halved = stored(halved.hint("merge").join(sizes.hint("merge"), "key"))
    few = segments.filter(F.col("k") <= most).select(F.col("h").alias("key"), F.lit(0).cast("long").alias("o"), "h", "s", "doc", "g", "a", "p", "seg")
    few = few.unionByName(halved.filter(F.col("k") <= most).drop("k"))
    collections = (few.count() // COLLECTION) + 1

    def sort(batch: pa.Table) -> pa.Table:
        segs = batch.column("seg").to_pylist()
        keep = np.flatnonzero(may_share(batch.column("key").to_pylist(), segs, batch.column("p").to_pylist(), width, gram))
        batch, segs = batch.take(keep), [segs[i] for i in keep]
        place = np.stack([batch.column(c).to_numpy() for c in ("doc", "g")], 1)
        doc = np.unique(place, axis=0, return_inverse=True)[1].ravel()
        x, off = repeated_windows(segs, doc, batch.column("a").to_numpy(), width)
        h, s, o = (batch.column(c).to_numpy() for c in ("h", "s", "o"))
        return pa.table({"h": h[x], "s": s[x], "off": (o[x] + off).astype(np.int32)})

    few = few.withColumn("c", F.pmod(F.xxhash64("key"), F.lit(collections)))
    gone = few.groupBy("c").applyInArrow(sort, "h long, s long, off int")

    def windows(batches):
        for b in batches:
            out = []
            for h, s, doc, g, a, o, seg in zip(*(b.column(c).to_pylist() for c in ("h", "s", "doc", "g", "a", "o", "seg"))):
                data = np.frombuffer(seg, np.uint8)
                at = np.arange(len(data) - width + 1)
                out.append((np.full(len(at), h), np.full(len(at), s), np.full(len(at), doc), np.full(len(at), g), a + at, o + at, Hasher(data).of(at, at + width).view(np.int64), Hasher(data, 0xA24BAED4963EE407).of(at, at + width).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "s", "doc", "g", "at", "off", "x", "y"])

    each = halved.filter(F.col("k") > most).mapInArrow(windows, "h long, s long, doc long, g long, at long, off long, x long, y long")
    least = each.groupBy("x", "y").agg(F.min(F.struct("doc", "g", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("x", "y", F.col("first.doc").alias("d0"), F.col("first.g").alias("g0"), F.col("first.at").alias("a0"))
    hot = each.hint("merge").join(least.hint("merge"), ["x", "y"]).filter("doc <> d0 OR g <> g0 OR at <> a0").select("h", "s", F.col("off").cast("int").alias("off"))
    masks = gone.unionByName(hot).groupBy("h", "s").agg(F.array_sort(F.collect_set("off")).alias("offs"))
    firsts = classes.join(masks, ["h", "s"], "left").select("h", "s", F.col("doc").alias("d0"), F.col("g").alias("g0"), F.col("place").alias("p0"), "offs")
    each = found.hint("merge").join(firsts.hint("merge"), ["h", "s"])
    again = (F.col("doc") != F.col("d0")) | (F.col("g") != F.col("g0")) | (F.col("place") != F.col("p0"))
    start = F.shiftright("place", 16)
    whole = F.array(F.shiftleft(start, 8).bitwiseOR(F.shiftright("place", 8).bitwiseAND(255)))
    some = F.transform("offs", lambda o: F.shiftleft(start + o, 8).bitwiseOR(F.lit(1)))
    runs = each.select("doc", "g", F.explode(F.when(again, whole).otherwise(F.coalesce(some, F.array()))).alias("run"))
    return runs.groupBy("doc", "g").agg(F.collect_set("run").alias("spans"))


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    names = ["h", "s", "doc", "g", "a", "k", "p", "seg"]
    cols = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], names=names)


def covered(spans: list[int], width: int = WIDTH) -> np.ndarray:
    """Maximal runs [start, stop) of the bytes that repeated windows cover."""
    x = np.sort(np.array(spans, np.int64))
    start, stop = x >> 8, (x >> 8) + (x & 255) - 1 + width
    reach = np.maximum.accumulate(stop)
    new = np.r_[True, start[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([start[first], reach[np.r_[first[1:] - 1, len(x) - 1]]], 1)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST_CLASSES) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start, stop>>, kept binary) for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("g"))
    packed, spans = _bytes_of(docs, repeats(docs, width, gram, most), "spans")
    joined = packed.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("g") == F.col("_g")), "left").select("doc_id", "z", "spans")

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist()):
                text = _unpack(z)
                n.append(len(text))
                runs = covered(spans, width).tolist() if spans else []
                edges = [0, *(x for r in runs for x in r), len(text)]
                gone.append([{"start": a, "stop": e} for a, e in runs])
                kept.append(b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")


def query(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda t, r: t + r["stop"] - r["start"])
    return out.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS k FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS fresh FROM again),
numbered AS (SELECT doc_id, i, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
gone AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS e FROM numbered GROUP BY doc_id, run),
kept AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM gone),
joined AS (
  SELECT d.doc_id, any_value(x) AS x, count(a) AS n_spans, CAST(coalesce(sum(e - a), 0) AS BIGINT) AS n_removed, coalesce(max(e), 0) AS last,
    coalesce(string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a), '') AS head
  FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, len(x) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(head || substr(x, 2 * last + 1))) AS kept_sha256 FROM joined
"""
