"""Best-fit-decreasing packing of token ids into fixed-length rows.

Documents are dealt to shards of bounded size by a hash. In each shard they are encoded, texts longer than a row are
split losslessly into full rows and a rest, and rests are placed, longest first, in the row with the least room that
still fits, found in a segment tree over the capacities. Each row is written with its ids, the cumulative lengths of its
segments, positions that start again in each, and the document and offset that each segment comes from.

Defined cases. Null or empty text: the end id alone. Null doc_id is carried into doc_ids. Rows that repeat are packed
each. Ties in length go by doc_id, then text hash and offset, nulls first, so the result depends only on the rows. An
empty table gives no rows; other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_of
from .piece_codec import codec

#: The ids have the type of the input's.
SCHEMA = "shard long, row long, n_tokens int, doc_ids array<{}>, doc_offsets array<long>, cu_seqlens array<int>, ids binary, positions binary"


class Capacities:
    """Segment tree over room sizes 0..most: how many open rows have just so much room, and which."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of need or more, or None."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not self.count[at]:
                    at += 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Places items, given longest first, into rows of length; each row lists its items."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for item, size in enumerate(sizes):
        room, row = open_rows.take(size) or (length, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(item)
        if room > size:
            open_rows.put(room - size, row)
    return rows


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<i4")


def pack_shard(keys: list, ids: list[np.ndarray], length: int):
    """Yields (segments, ids) for each row: segments are (key, offset in the document, size)."""
    pieces = [(min(length, len(x) - at), d, at) for d, x in enumerate(ids) for at in range(0, max(1, len(x)), length)]
    pieces.sort(key=lambda p: -p[0])
    for row in best_fit([p[0] for p in pieces], length):
        segments = [pieces[i] for i in row]
        yield [(keys[d], at, n) for n, d, at in segments], np.concatenate([ids[d][at : at + n] for n, d, at in segments])


def pack(docs: DataFrame, model: bytes, length: int = 2048, shard_bytes: int = 4 << 20, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of SCHEMA. ids and positions are little-endian matrices' rows of `length` entries, padded at the end
    (positions by 0); the type is id_type() of the vocabulary for ids, and of length for positions."""
    text = text_of(text_col)
    total = docs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    shards = total // shard_bytes + 1
    kind = docs.schema[id_col].dataType
    types = _types(to_arrow_type(kind))
    ids_as, pos_as = id_type(codec(model).size), id_type(length)

    def run(batches):
        c = codec(model)
        rows = [(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("shard").to_pylist()) for b in batches]
        keyed = [(d, hashlib.md5(t.encode()).digest(), t) for ds, ts, _ in rows for d, t in zip(ds, ts)]
        order = sorted(range(len(keyed)), key=lambda i: (keyed[i][0] is not None, *keyed[i][:2]))
        shard = rows[0][2][0]
        ids = [x.astype(ids_as) for x in c.encode([keyed[i][2] for i in order])]
        keys = [keyed[i][0] for i in order]
        out: list[tuple] = []
        for k, (segments, flat) in enumerate(pack_shard(keys, ids, length)):
            n = len(flat)
            sizes = [z for _, _, z in segments]
            m, p = np.full(length, pad, ids_as), np.zeros(length, pos_as)
            m[:n] = flat
            p[:n] = np.concatenate([np.arange(z) for z in sizes])
            out.append((shard, k, n, [s[0] for s in segments], [s[1] for s in segments], [0, *np.cumsum(sizes).tolist()], m.tobytes(), p.tobytes()))
            if len(out) == 256:
                yield _batch(out, types)
                out = []
        if out:
            yield _batch(out, types)

    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(_streamed(run), SCHEMA.format(kind.simpleString()))


def _types(id_kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("shard", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(id_kind)), ("doc_offsets", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary()),
    ])


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)


def _streamed(run):
    from collections.abc import Iterator

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    return grouped


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(doc_id, offset, ids): the segments again, in whatever order."""

    kind = packed.schema["doc_ids"].dataType.elementType

    def run(batches):
        for b in batches:
            d, o, out = [], [], []
            for r in b.to_pylist():
                flat = np.frombuffer(r["ids"], dtype)
                cu = r["cu_seqlens"]
                for k, (doc, at) in enumerate(zip(r["doc_ids"], r["doc_offsets"])):
                    d.append(doc)
                    o.append(at)
                    out.append(flat[cu[k] : cu[k + 1]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(d, b.schema.field("doc_ids").type.value_type), pa.array(o, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "offset", "ids"])

    return packed.select("doc_ids", "doc_offsets", "cu_seqlens", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, offset long, ids array<int>")
