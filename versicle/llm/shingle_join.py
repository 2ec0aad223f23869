"""N-gram Jaccard join with several global token orders, and its connected components.

Documents become sets of hashed word shingles; equal sets are one class, known by 128 bits. A sketch of document
frequencies puts rare shingles first, and several hash orders break its ties, each giving every class a prefix that any
partner at the threshold must meet. Most tokens of the first order's prefixes are one document's only, so they are dealt
once, packed to about six bytes each, and only those that two documents share become rows. Classes that share one are in
one bucket. Pairs that are to be verified must have fitting sizes, fit by the places at which they meet, and meet in all
further orders too.

Large buckets are not expanded into pairs. Each bucket has a pivot p, the member that meets most. For any p the sets x
and y differ as much as their differences to p do: x ^ y = (x ^ p) ^ (y ^ p). What a group of near copies has in common
cancels in these differences, so the prefixes of the differences, taken in the order of how rare their tokens are within
the group, meet only where two members share changes. So members are dealt anew to the buckets (p, token of the
difference's prefix). Members that are similar to p are in one component already, so only pairs with at least one
member that is not similar to p have to meet, which bounds how much two differences must share and so their prefixes.
Members with less than half of their union in common with p stay in their bucket, which has lost p.

Turns are taken until the pairs of different components are no more than a few for each membership, or no longer shrink;
these pairs are filtered and verified directly. No link is lost on either way.

Shingles have 64 bits: a collision counts as one equal shingle of two sets that are otherwise compared in full. Sets of
one shingle are named by 128 bits of their words.

Defined cases. Null or empty text, or one without words: an empty set, linked with nothing, its component is its own
doc_id. Fewer than `size` words: the sequence is one shingle. Null doc_id: takes part, is never a component's id unless
all its ids are null. Rows that repeat are one class. A document's own ties do not matter, as sets are compared. Very
long texts and words are read whole. Empty tables give empty results; further columns are not read.
"""

from itertools import tee

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fingerprint, slices, stored, text_of, trimmed

ORDERS = 3
#: 2^24 counters: 16 MB whatever the corpus, in blocks of 16384.
SKETCH_BITS, SKETCH_BLOCK = 24, 16384
#: Pairs for each membership of a bucket up to which all pairs are taken at once.
FEW = 2
#: A part of the hash space is read at once: about 20,000 tokens at 0.5 GB of texts, a million at 30 GB.
PARTS = 1024
_BLOCK_ROWS = 1 << 16
#: Documents whose shingles 16 bits can count; then a task hands on its counters and starts anew.
_COUNTED = 1 << 15
_U = np.uint64
_BLOCK_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, and where each text's begin and end.

    Words are read eight bytes at a time, each mixed with the hash of what is before it."""
    joined = b"\n".join(texts).lower() + b"\n" + bytes(8)  # bytes.lower() changes A-Z only
    data = np.frombuffer(joined, np.uint8)[:-8]
    eight = np.ndarray(len(data), "<u8", joined, strides=(1,))
    edge = np.diff(np.r_[True, _SPACE[data]].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = ends - starts
    h = _mix(size.astype(np.uint64))
    left = np.flatnonzero(size <= _LONG_WORD)
    at = 0
    while len(left):
        rest = size[left] - at
        lane = eight[starts[left] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(rest, 8)) * 8).astype(np.uint64))
        h[left] = _mix((h[left] ^ lane) * _U(0x9E3779B97F4A7C15) + lane)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
    return h, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def shingle_sets(texts: list[str | bytes | None], size: int):
    """Yields the sorted distinct shingle hashes of each text; bytes are UTF-8."""
    mult = _mix(np.arange(1, size + 1, dtype=np.uint64)) | _U(1)
    block: list[bytes] = []

    def flush():
        h, at = _word_hashes(block)
        full = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            full += h[k : k + len(full)] * mult[k]
        full = _mix(full)
        for a, b in zip(at, at[1:]):
            if b - a >= size:
                yield np.unique(full[a : b - size + 1])
            elif b > a:
                yield _mix(np.array([(h[a:b] * mult[: b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)

    held = 0
    for t in texts:
        block.append(t if isinstance(t, bytes) else (t or "").encode())
        held += len(block[-1])
        if held >= _BLOCK_BYTES:
            yield from flush()
            block, held = [], 0
    if block:
        yield from flush()


def class_of(s: np.ndarray, text: str | bytes | None, size: int) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    if len(s) == 1:
        words = (text if isinstance(text, bytes) else text.encode()).lower().split()[:size]
        name = xxhash.xxh3_128_digest(b" ".join(words))
    else:
        name = xxhash.xxh3_128_digest(s.tobytes())
    return tuple(np.frombuffer(name, np.int64).tolist())


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> _U(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Document frequencies by hash slot, over all documents. Fixed in size, so it may go to the driver and back."""

    def run(batches):
        counts, room = np.zeros(1 << SKETCH_BITS, "<u2"), _COUNTED
        small = counts.reshape(-1, SKETCH_BLOCK)
        squeeze = zstandard.ZstdCompressor(level=1).compress  # most counts of one task are below 4

        def out():
            some = np.flatnonzero(small.any(1))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([squeeze(small[i].tobytes()) for i in some], pa.binary())], names=["block", "counts"])

        for b in batches:
            for s in shingle_sets(_texts(b), size):
                if not room:
                    yield out()
                    counts[:], room = 0, _COUNTED
                np.add.at(counts, _slots(s), 1)
                room -= 1
        yield out()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(c), "<u2").astype(np.int64)
        # only the magnitude matters for the order
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_magnitude(v).tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    blocks = docs.select("text").mapInArrow(trimmed(run), "block int, counts binary")
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.uint8).reshape(-1, SKETCH_BLOCK)
    for r in blocks.repartition("block").mapInArrow(trimmed(add), "block int, counts binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def _magnitude(v: np.ndarray) -> np.ndarray:
    """Twice the binary logarithm, so that counts of one order of size are alike in rarity."""
    return np.minimum(255, np.floor(2 * np.log2(np.maximum(v, 1)))).astype(np.uint8)


def prefix_size(n: int, percent: int) -> int:
    """Any set that is similar by percent or more has one of these many first elements: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def least_size(percent: int) -> int:
    """Smaller sets are similar to equal ones only: n of n + 1 elements must reach percent."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _first(s: np.ndarray, magnitude: np.ndarray, k: int, order: int) -> np.ndarray:
    """The first k elements of s, by magnitude and then by the hash of that order."""
    rank = (magnitude.astype(np.uint64) << _U(56)) | (_mix(s + _U(order)) >> _U(8))
    some = np.argpartition(rank, k - 1)[:k] if k < len(s) else np.arange(len(s))
    return s[some[np.argsort(rank[some])]]


def classes(docs: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """(doc_id, g1, g2, v, w, n, key, part, tokens, places) for docs (doc_id, g1, g2, text): a row with part null for each
    of docs, with its class and set size, and rows that hold the first order's prefixes of a block of documents, dealt to
    PARTS parts of the hash space.

    In such a row, tokens are 32 bits of each token, as part has further bits of it; places are whose it is and where in
    the prefix, see _places. key + that owner is the key of a row of docs. A class is an owner once in a block."""

    def run(batches):
        rarity, at = counts.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in (whole.slice(i, _BLOCK_ROWS) for i in range(0, len(whole), _BLOCK_ROWS)):
                texts, same = tee(_texts(b))
                v, w, n, p, owners, seen = [], [], [], [], [], set()
                for i, (t, s) in enumerate(zip(texts, shingle_sets(same, size))):
                    one, two = class_of(s, t, size) if len(s) else (0, 0)
                    v.append(one)
                    w.append(two)
                    n.append(len(s))
                    if len(s) >= least_size(percent) and (one, two) not in seen:
                        seen.add((one, two))
                        owners.append(i)
                        p.append(_first(s, rarity[_slots(s)], prefix_size(len(s), percent), 0))
                none = [pa.nulls(len(b), kind) for kind in (pa.int32(), pa.binary(), pa.binary())]
                cols = [b.column("doc_id"), b.column("g1"), b.column("g2"), pa.array(v, pa.int64()), pa.array(w, pa.int64()), pa.array(n, pa.int32()), pa.array(range(at, at + len(b)), pa.int64()), *none]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                parts = _parted(p, owners)
                none = [pa.nulls(len(parts), c.type) for c in cols[:6]]
                cols = [*none, pa.array([at] * len(parts), pa.int64()), *(pa.array([q[i] for q in parts], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary())))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += _BLOCK_ROWS

    names = ["doc_id", "g1", "g2", "v", "w", "n", "key", "part", "tokens", "places"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(trimmed(run), f"doc_id {kind}, g1 long, g2 long, v long, w long, n int, key long, part int, tokens binary, places binary")


def _parted(prefixes: list[np.ndarray], owners: list[int]) -> list[tuple[int, bytes, bytes]]:
    """(part, tokens, places) for all parts of which the owners' prefixes have tokens."""
    token = np.concatenate([*prefixes, np.empty(0, np.uint64)])
    owner = np.repeat(np.array(owners, np.int64), [len(p) for p in prefixes])
    at = np.concatenate([*map(np.arange, map(len, prefixes)), np.empty(0, np.int64)])
    part = ((token >> _U(32)) % _U(PARTS)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    token, owner, at = token[order].astype("<u4"), owner[order], at[order]
    ends = np.cumsum(np.bincount(part, minlength=PARTS))
    starts = np.r_[0, ends[:-1]]
    return [(int(k), token[a:b].tobytes(), _places(owner[a:b], at[a:b])) for k, a, b in zip(range(PARTS), starts, ends) if b > a]


def _places(owner: np.ndarray, at: np.ndarray) -> bytes:
    """Ascending owners and places in their prefixes, compressed. Places count up to 65535: a lower place only rules out less."""
    both = np.stack([np.diff(owner, prepend=0), np.minimum(at, 0xFFFF)]).astype("<u2")
    return zstandard.ZstdCompressor(level=3).compress(both.view(np.uint8).reshape(2, -1, 2).transpose(0, 2, 1).tobytes())


def _read_places(places: bytes) -> tuple[np.ndarray, np.ndarray]:
    low_high = np.frombuffer(zstandard.ZstdDecompressor().decompress(places), np.uint8).reshape(2, 2, -1).astype(np.int64)
    steps, at = low_high[:, 0] | low_high[:, 1] << 8
    return np.cumsum(steps), at


def shared(parts: DataFrame) -> DataFrame:
    """(b, key, at): the tokens, as 42 bits, that two owners or more have, with each of their owners. Tokens that only
    agree in these bits make two classes candidates too often."""

    def run(part: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(t, "<u4") for t in part.column("tokens").to_pylist()])
        order = np.argsort(token, kind="stable")
        same = np.diff(token[order]) == 0
        some = order[np.r_[False, same] | np.r_[same, False]]
        places = [_read_places(p) for p in part.column("places").to_pylist()]
        key = np.concatenate([k + owner for k, (owner, _) in zip(part.column("key").to_pylist(), places)])
        at = np.concatenate([at for _, at in places])
        b = token[some].astype(np.int64) | part.column("part")[0].as_py() << 32
        return pa.Table.from_arrays([pa.array(b, pa.int64()), pa.array(key[some], pa.int64()), pa.array(at[some], pa.int32())], names=["b", "key", "at"])

    return parts.select("part", "key", "tokens", "places").groupBy("part").applyInArrow(run, "b long, key long, at int")


def _lists(rows: list[np.ndarray], dtype) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*rows, np.empty(0, dtype)])))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, z): compressed texts of wanted (x, g1, g2)."""

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([c.compress((t or "").encode()) for t in _texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("g1"), b.column("g2"), packed], names=["g1", "g2", "z"])

    packed = docs.select("g1", "g2", "text").mapInArrow(trimmed(squeeze), "g1 long, g2 long, z binary")
    return packed.hint("merge").join(wanted.hint("merge"), ["g1", "g2"]).dropDuplicates(["g1", "g2"]).select("x", "z")


def _texts(batch: pa.RecordBatch):
    for part in slices(batch, "text"):
        yield from part.column("text").to_pylist()


def _met(pairs: DataFrame, texts: DataFrame, size: int):
    """pairs (x, p, ...) with the texts of both, for mapInArrow, and a function that yields (part of a batch, sets of x,
    sets of p). The texts' columns keep their names in both joins, so that one exchange of them serves both."""
    of = texts.select(F.col("x").alias("key"), F.col("z").alias("text"))
    rest = [c for c in pairs.columns if c != "x"]
    left = pairs.hint("merge").join(of.hint("merge"), F.col("x") == F.col("key")).select("x", *rest, F.col("text").alias("z"))
    both = left.hint("merge").join(of.hint("merge"), F.col("p") == F.col("key")).select("x", *rest, "z", F.col("text").alias("zp"))

    def sets(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for part in slices(b, "z"):
                ps, zp = part.column("p").to_pylist(), part.column("zp")
                first = {p: i for i, p in enumerate(ps)}
                of_p = dict(zip(first, shingle_sets([expand(zp[i].as_py()) for i in first.values()], size)))
                yield part, shingle_sets([expand(z) for z in part.column("z").to_pylist()], size), [of_p[p] for p in ps]

    return both, sets


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _meet(x: np.ndarray, p: np.ndarray, rarity: np.ndarray, percent: int) -> bool:
    """Whether the prefixes of two sets meet in every order after the first."""
    mx, mp = rarity[_slots(x)], rarity[_slots(p)]
    kx, kp = prefix_size(len(x), percent), prefix_size(len(p), percent)
    return all(_common(_first(x, mx, kx, o), _first(p, mp, kp, o)) for o in range(1, ORDERS))


def verified(pairs: DataFrame, texts: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """The pairs (x, p), which meet in the first order, that meet in all and are similar on their whole sets."""
    both, sets = _met(pairs, texts, size)

    def run(batches):
        for part, xs, ps in sets(batches):
            ok = []
            for x, p in zip(xs, ps):
                i = _common(x, p) if _meet(x, p, counts.value, percent) else 0
                ok.append(100 * i >= percent * (len(x) + len(p) - i))
            yield pa.RecordBatch.from_arrays([part.column("x"), part.column("p"), pa.array(ok, pa.bool_())], names=["x", "p", "ok"])

    return both.select("x", "p", "z", "zp").mapInArrow(trimmed(run), "x long, p long, ok boolean").filter("ok").select("x", "p")


def difference_prefix(d: np.ndarray, p: np.ndarray, k: int, group: int, magnitude: np.ndarray) -> np.ndarray:
    """The first k elements of d = x ^ p, by how many of the group's differences have them, about: elements of p are in
    the differences of those who lack them, others in those of who has them."""
    count = 2.0 ** (magnitude / 2)
    inside = np.isin(d, p, assume_unique=True)
    count = np.where(inside, np.maximum(group / 8 + 2, group + 1 - count), np.minimum(count, max(2, group)))
    return _first(d, _magnitude(count.astype(np.int64)), k, 0)


def _against_pivots(pairs: DataFrame, texts: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """pairs (x, p, g, ...) with common, the shared shingles, and tokens, the prefix of the difference; g is the group's size."""
    both, sets = _met(pairs, texts, size)
    kept = [f for f in pairs.columns if f not in ("x", "p")]

    def run(batches):
        rarity = counts.value
        for part, xs, ps in sets(batches):
            common, tokens = [], []
            for x, p, g in zip(xs, ps, part.column("g").to_pylist()):
                if g == 1 and not _meet(x, p, rarity, percent):  # only whether they are similar matters
                    common.append(0)
                    tokens.append(np.empty(0, np.int64))
                    continue
                i = _common(x, p)
                s, union = len(x) + len(p), len(x) + len(p) - i
                k = 0
                if g > 1 and 2 * i >= union:
                    a = s - 2 * i
                    if 100 * i >= percent * union:  # what x must share with the difference of any y that is not similar to p
                        need = a * percent // (100 + percent) + 1
                    else:
                        need = max(1, -(-(a * (100 + percent) - s * (100 - percent)) // 200))
                    k = a - need + 1
                common.append(i)
                if k > 0:
                    d = np.setxor1d(x, p, assume_unique=True)
                    tokens.append(difference_prefix(d, p, k, g, rarity[_slots(d)]).view(np.int64))
                else:
                    tokens.append(np.empty(0, np.int64))
            cols = [part.column("x"), part.column("p"), *(part.column(c) for c in kept), pa.array(common, pa.int32()), _lists(tokens, np.int64)]
            yield pa.RecordBatch.from_arrays(cols, names=["x", "p", *kept, "common", "tokens"])

    types = ", ".join(f"{f} {pairs.schema[f].dataType.simpleString()}" for f in kept)
    return both.select("x", "p", "z", "zp", *kept).mapInArrow(trimmed(run), f"x long, p long, {types}, common int, tokens array<long>")


def _union(batches):
    """Edges (x, y) as stars around the least node, as far as one task knows."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    def out():
        pairs = [(x, find(x)) for x in root]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([q[i] for q in pairs], pa.int64()) for i in (0, 1)], names=["x", "y"])

    for b in batches:
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        if len(root) >= 1 << 20:  # bounded memory: what follows starts anew
            yield out()
            root.clear()
    yield out()


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (x, c) with the components c that links (x, p) join made one, each named by its least c.

    Every component points to its least neighbour, chains of pointers are halved, links are carried over to what they
    point to, until none is left between different components. All tables stay distributed and are stored each round.
    """
    of = lambda side: labels.select(F.col("x").alias(side), F.col("c").alias(f"c{side}"))
    edges = links.join(of("x"), "x").join(of("p"), "p").select(F.col("cx").alias("x"), F.col("cp").alias("y")).filter("x <> y")
    edges = stored(edges.mapInArrow(_union, "x long, y long"))
    spent = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = stored(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("r")))
        spent += [edges, up]
        up = stored(up.join(up.select(F.col("x").alias("r"), F.col("r").alias("rr")), "r", "left").select("x", F.coalesce("rr", "r").alias("r")))
        after = stored(labels.join(up.withColumnRenamed("x", "c"), "c", "left").select("x", F.coalesce("r", "c").alias("c")))
        spent += [labels, up]
        labels = after
        to = lambda side: up.select(F.col("x").alias(side), F.col("r").alias(f"r{side}"))
        edges = edges.join(to("x"), "x").join(to("y"), "y").select(F.col("rx").alias("x"), F.col("ry").alias("y")).filter("x <> y")
        edges = stored(edges.mapInArrow(_union, "x long, y long"))
    dropped(*spent, edges)
    return labels


def _most(total: str, percent: int) -> Column:
    """By how many elements two sets of so many in total may differ."""
    return F.expr(f"({total}) * {100 - percent} div {100 + percent}")


def _fits(percent: int) -> Column:
    """Whether a pair of memberships may be similar: sizes of the differences, and what can still be shared after the
    places (from 0) at which both have the bucket's token, against what must be."""
    most = _most("n + cast(n2 as bigint)", percent)
    shared = 2 * F.least(F.col("a") - F.col("at"), F.col("a2") - F.col("at2"))
    return (F.abs(F.col("a") - F.col("a2")) <= most) & (shared >= F.col("a") + F.col("a2") - most)


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, g1, g2, v, w, c) for each row of docs (doc_id, text): g1 and g2 are the fingerprint
    of id and text, v and w name the class; c names the component, null for classes that meet no other."""
    g1, g2 = row_key()
    docs = docs.select("doc_id", g1.alias("g1"), g2.alias("g2"), "text")
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, size))  # 16 MB, see SKETCH_BITS
    found = stored(classes(docs, counts, size, percent))
    rows = stored(found.filter("part IS NULL").drop("part", "tokens", "places"))
    # 64 bits of a class do here: classes that shared them would only be candidates too often
    met = stored(shared(found.filter("part IS NOT NULL")))
    dropped(found)
    once = met.hint("merge").join(rows.select("key", "v", "n").hint("merge"), "key").groupBy("b", "v").agg(F.max("n").alias("n"), F.min("at").alias("at"))
    # most buckets hold two classes that share a phrase; what their sizes and places rule out needs no text
    ends = once.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), (F.max("n") - F.min("n")).alias("apart"), F.min(F.col("n") - F.col("at")).alias("left"))
    most = _most("total", percent)
    able = ends.filter((F.col("m") > 2) | ((F.col("m") == 2) & (F.col("apart") <= most) & (2 * F.col("left") >= F.col("total") - most))).select("b")
    once = stored(once.hint("merge").join(able.hint("merge"), "b"))
    named = rows.filter("n > 0").groupBy("v", "w").agg(F.min("doc_id").alias("least"), F.min(F.struct("g1", "g2")).alias("g"))
    known = named.join(once.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("s")), "v").select("v", "w", "s", "g")
    known = stored(known.withColumn("x", F.monotonically_increasing_id()))
    state = stored(once.join(known.select("v", "x", "s"), "v").select("b", "x", "n", "s", F.col("n").alias("a"), "at"))
    texts = stored(_texts_of(docs, known.select("x", "g.g1", "g.g2")))
    labels = stored(known.select("x", F.col("x").alias("c")))
    spent, before = [met, once, state], None
    while True:
        at = state.join(labels, "x")
        bucket = at.groupBy("b", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("within"))
        mixed = stored(bucket.filter("m * m > within"))
        spent.append(mixed)
        pairs, members = mixed.agg(F.sum(F.expr("(m * m - within) / 2")), F.sum("m")).first()
        if not pairs:
            break
        at = stored(at.hint("merge").join(mixed.select("b").hint("merge"), "b"))
        spent.append(at)
        if pairs <= FEW * members or (before and pairs > before / 2):
            two = at.select("b", *(F.col(c).alias(f"{c}2") for c in ("x", "n", "a", "at", "c")))
            near = at.hint("merge").join(two.hint("merge"), "b").filter((F.col("c") < F.col("c2")) & _fits(percent))
            near = near.select("x", F.col("x2").alias("p")).distinct()
            links = stored(verified(near, texts, counts, size, percent))
            spent.append(links)
            labels = contract(labels, links)
            break
        before = pairs
        links, state = _turn(at, texts, counts, size, percent)
        spent += [links, state]
        labels = contract(labels, links)
    dropped(*spent, texts)
    classed = named.select("v", "w", "least").join(known.select("v", "w", "x").join(labels, "x").select("v", "w", "c"), ["v", "w"], "left")
    least = classed.filter("c IS NOT NULL").groupBy("c").agg(F.min("least").alias("component"))
    classed = classed.join(least, "c", "left").select(F.col("v").alias("v2"), F.col("w").alias("w2"), "c", F.when(F.col("c").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
    # copies of one class may be very many: the join's exchange is split by AQE
    out = rows.drop("key").hint("merge").join(classed.hint("merge"), (F.col("v") == F.col("v2")) & (F.col("w") == F.col("w2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "g1", "g2", "v", "w", "c")


def _turn(at: DataFrame, texts: DataFrame, counts, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to the pivots of all buckets of at (b, x, n, s, a, at), and the memberships whose pairs are still to be met."""
    pivot = at.groupBy("b").agg(F.max(F.struct("s", F.col("x").alias("p"), F.col("n").alias("np"))).alias("top")).select("b", "top.p", "top.np")
    from_pivot = at.hint("merge").join(pivot.hint("merge"), "b").filter("x <> p")
    where = F.collect_list(F.struct("b", "a", "at")).alias("where")  # at most as many as a prefix has
    pairs = from_pivot.groupBy("x", "p").agg(F.max("n").alias("n"), F.max("np").alias("np"), F.max("s").alias("s"), where)
    groups = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("g"))
    pairs = stored(pairs.hint("merge").join(groups.hint("merge"), "p"))
    fits = lambda q: q * F.greatest("n", "np") <= 100 * F.least("n", "np")
    some = pairs.filter("g > 1")
    found = stored(_against_pivots(pairs.filter(F.when(F.col("g") == 1, fits(percent)).otherwise(fits(50))), texts, counts, size, percent))
    union = F.col("n") + F.col("np") - F.col("common")
    links = stored(found.filter(100 * F.col("common") >= percent * union).select("x", "p"))
    met = found.filter("g > 1")
    halves = met.filter(2 * F.col("common") >= union)
    open_groups = halves.filter(100 * F.col("common") < percent * union).select("p").distinct()
    fresh = halves.hint("merge").join(open_groups.hint("merge"), "p", "left_semi").select("x", "n", "s", "p", (union - F.col("common")).alias("a"), F.posexplode("tokens").alias("at", "token"))
    fresh = fresh.select(F.xxhash64("p", "token").alias("b"), "x", "n", "s", "a", "at")
    stays = met.filter(100 * F.col("common") < (150 - percent) * union).select("x", "n", "s", "where")
    stays = stays.unionByName(some.filter(~fits(50)).select("x", "n", "s", "where"))
    stays = stays.select("x", "n", "s", F.inline("where")).select("b", "x", "n", "s", "a", "at")
    state = stored(fresh.unionByName(stays))
    dropped(pairs, found)
    return links, state


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Fingerprint of a row's id and text; a null text counts as empty."""
    return fingerprint(F.col(id_col).cast("string"), text_of(text_col))


def query(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.v = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
