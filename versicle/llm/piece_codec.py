"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no merge can reach across; each distinct word is encoded once, many words at a time: flat symbol
arrays, the least pair rank of each word by a segmented minimum, all leftmost pairs of that rank merged at once, and
compaction until no pair remains. Words whose best pair could be overtaken by what its own merge makes are merged one
place at a time, so that the order of merges is that of the library's queue.

Defined cases. Null or empty text: no piece, only the end id where one is asked for. Very long texts are cut into
blocks at word boundaries; one very long word is finished with a queue if it needs too many rounds. Rows that repeat
are encoded alike; other columns are carried by `encode` and `decode`. An empty table gives an empty result.
"""

import codecs
import hashlib
import heapq
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, trimmed

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
NO_PAIR = np.iinfo(np.int32).max
#: Of the hash of a pair. Then: rounds after which what is left of the longest words goes to the queue; words and their code points kept in a worker's memory; code points encoded at a time.
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
ROUNDS, CACHED_WORDS, CACHED_CHARS, BLOCK_CHARS = 400, 250_000, 1 << 22, 1 << 20

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Encoder and decoder of one model file's contents."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        n, t = proto.normalizer_spec, proto.trainer_spec
        kinds = [p.type for p in proto.pieces]
        if t.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix or not t.byte_fallback or proto.denormalizer_spec.precompiled_charsmap or USER in kinds or UNUSED in kinds:
            raise ValueError("only BPE models with byte fallback and identity normalisation are handled")
        self.prefix = SPACE if n.add_dummy_prefix else ""
        self.strips = bool(n.add_dummy_prefix)
        self.size = len(kinds)
        self.eos = kinds and next((i for i, p in enumerate(proto.pieces) if p.type == CONTROL and p.piece == (t.eos_piece or "</s>")), -1)
        self._symbols(proto)
        self._decoder(proto, t.unk_surface or " ⁇ ")
        self._forget()

    def _symbols(self, proto) -> None:
        pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        ids = {p: i for p, (i, _) in pieces.items()}
        for p in pieces:  # single characters of pieces are symbols even if they are no pieces
            for c in p:
                ids.setdefault(c, self.size + len(ids))
        self.ids = ids
        self.base = max(ids.values()) + 2
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        keys, rank, made = [], [], []
        for p, (i, s) in pieces.items():
            for k in range(1, len(p)):
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    rank.append(order[s])
                    made.append(i)
        # one more entry for pairs that make no piece
        self.keys, self.rank, self.made = np.array([*keys, -1], np.int64), np.array([*rank, NO_PAIR], np.int32), np.array([*made, -1], np.int32)
        self._pairs()
        # ranks whose piece takes part in a pair of equal or better rank
        rank_of = np.full(self.base, -1, np.int64)
        for i, s in pieces.values():
            rank_of[i] = order[s]
        self.alone = np.zeros(len(order) + 1, bool)
        for part in (self.keys[:-1] // self.base, self.keys[:-1] % self.base):
            r = rank_of[part]
            self.alone[r[(r >= 0) & (self.rank[:-1] <= r)]] = True
        self.char_id = np.full(0x110000, -1, np.int32)
        for c, i in ids.items():
            if len(c) == 1:
                self.char_id[ord(c)] = i
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        merging = {c for p in pieces if len(p) > 1 for c in p}
        breaks = "\n" if "\n" not in merging else ""
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            self.words = re.compile(".+", re.S)
        else:
            self.words = re.compile(rf"{breaks}|{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" if breaks else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _decoder(self, proto, unknown: str) -> None:
        raw = []
        for p in proto.pieces:
            raw.append(b"" if p.type == CONTROL else unknown.encode() if p.type == UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.control = np.array([p.type == CONTROL for p in proto.pieces])
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])

    def _forget(self) -> None:
        self.index, self.chars = defaultdict(count().__next__), 0  # numbers words as they are met
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Keeps the words met more than once since they were last sorted out, the most frequent ones up to half of what is kept."""
        often = np.flatnonzero(self.met > 1)
        rows = np.sort(often[np.argsort(-self.met[often], kind="stable")[: CACHED_WORDS // 2]])
        words = list(self.index)
        size = np.array([len(words[i]) for i in rows], np.int64)
        rows = rows[np.cumsum(size) <= CACHED_CHARS // 2]
        flat, at = gather(self.flat, self.at, rows)
        self._forget()
        self.chars = sum(len(words[i]) for i in rows if self.index[words[i]] >= 0)
        self.flat, self.at, self.met = flat, at, np.zeros(len(rows), np.int64)

    def _pairs(self) -> None:
        """Hash table of the pairs: each key is in one of two slots."""
        n = len(self.keys) - 1
        self.shift = np.uint64(64 - max(8, (4 * n).bit_length()))
        slots = 1 << (64 - int(self.shift))
        at = [((self.keys[:-1].astype(np.uint64) * m) >> self.shift).tolist() for m in MULTIPLIERS]
        table = [[-1] * slots, [-1] * slots]
        for k in range(n):
            side = 0
            for _ in range(500):
                slot = at[side][k]
                k, table[side][slot] = table[side][slot], k
                if k < 0:
                    break
                side = 1 - side
            else:
                raise ValueError("the pairs don't fit their table")
        self.slots = [np.array(t, np.int32) for t in table]  # -1 is the entry of no pair
        self.slot_keys = [self.keys[t] for t in self.slots]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, and entry of each pair."""
        key = left * self.base + right
        key[(left < 0) | (right < 0)] = -2
        u = key.view(np.uint64)
        s = [((u * m) >> self.shift).view(np.int64) for m in MULTIPLIERS]
        i = np.full(len(key), -1, np.int32)
        for slot, keys, entries in zip(s, self.slot_keys, self.slots):
            hit = np.flatnonzero(keys[slot] == key)
            i[hit] = entries[slot[hit]]
        return self.rank[i], i

    def _queue(self, sym: list[int]) -> list[int]:
        """Merges one word's symbols to the end in the library's order: best rank, then leftmost."""
        find = {}

        def pair(a: int, b: int):
            if (a, b) not in find:
                r, i = self._lookup(np.array([a], np.int64), np.array([b], np.int64))
                find[a, b] = (int(r[0]), int(self.made[i[0]])) if r[0] != NO_PAIR else None
            return find[a, b]

        n = len(sym)
        before, after, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := pair(sym[i], sym[j])):
                heapq.heappush(heap, (p[0], i, j, sym[i], sym[j], p[1]))

        for i in range(n - 1):
            push(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if gone[i] or gone[j] or sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], gone[j], after[i] = m, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [s for s, g in zip(sym, gone) if not g]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and where each begins and ends."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # unknown characters are kept as -1 - code point until they become bytes
        sym = np.where((known := self.char_id[code].astype(np.int64)) >= 0, known, -1 - code.astype(np.int64))
        done_sym, done_word = [], []
        for turn in range(ROUNDS + 1):
            if not len(sym):
                break
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), NO_PAIR, np.int32)
            i = np.zeros(len(sym), np.int32)
            rank[:-1], i[:-1] = self._lookup(sym[:-1], sym[1:])
            rank[np.r_[starts[1:] - 1, len(sym) - 1]] = NO_PAIR
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            over = np.repeat(least == NO_PAIR, size)
            done_sym.append(sym[over])
            done_word.append(word[over])
            if turn == ROUNDS:  # the few that are left
                for s, z, o in zip(starts, size, least == NO_PAIR):
                    if not o:
                        rest = self._queue(sym[s : s + z].tolist())
                        done_sym.append(np.array(rest, np.int64))
                        done_word.append(np.full(len(rest), word[s]))
                break
            best = np.flatnonzero((rank == np.repeat(least, size)) & ~over)
            if not len(best):
                break
            new_run = np.r_[True, np.diff(best) > 1]
            run_start = best[np.maximum.accumulate(np.where(new_run, np.arange(len(best)), 0))]
            take = (best - run_start) % 2 == 0
            first_of_word = np.r_[True, word[best[1:]] != word[best[:-1]]]
            take &= ~self.alone[rank[best]] | first_of_word
            best = best[take]
            sym[best] = self.made[i[best]]
            keep = ~over
            keep[best + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        return self._bytes(sym[by], word[by], len(words))

    def _bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(odd := np.flatnonzero((sym < 0) | (sym >= self.size))):
            names = {i: c for c, i in self.ids.items() if i >= self.size}
            spelled = [(chr(-1 - s) if s < 0 else names[s]).encode("utf-8", "replace") for s in sym[odd].tolist()]
            width = np.ones(len(sym), np.int64)
            width[odd] = [len(b) for b in spelled]
            at = np.cumsum(width) - width
            out = np.repeat(sym, width)
            where = np.repeat(at[odd], width[odd]) + np.concatenate([np.arange(len(b)) for b in spelled])
            out[where] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
            sym, word = out, np.repeat(word, width)
        return sym.astype(np.int32), np.searchsorted(word, np.arange(n + 1))

    def _blocks(self, text: str):
        text = self.prefix + text.replace(" ", SPACE)
        at = 0
        while at < len(text):
            end = at + BLOCK_CHARS
            if end < len(text):
                m = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, end) if self.words.pattern != ".+" else None
                end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: list[str | None], eos: bool = True):
        """Yields an id array for each text, in order."""
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            words = [w for _, ws in held for w in ws]
            k = self._known(words)
            ids, at = gather(self.flat, self.at, k)
            edge = at[np.cumsum([0, *(len(ws) for _, ws in held)])]
            for (doc, _), a, b in zip(held, edge, edge[1:]):
                yield doc, ids[a:b]

        def parts():
            nonlocal held, size
            for doc, text in enumerate(texts):
                for block in self._blocks(text) if text else [""]:
                    held.append((doc, self.words.findall(block)))
                    size += len(block)
                    if size >= BLOCK_CHARS:
                        yield from flush()
                        held, size = [], 0
            yield from flush()

        end = np.array([self.eos] if eos else [], np.int32)
        at, got = 0, []
        for doc, ids in parts():
            if doc != at:
                yield np.concatenate([*got, end])
                at, got = doc, []
            got.append(ids)
        if texts:
            yield np.concatenate([*got, end])

    def _known(self, words: list[str]) -> np.ndarray:
        """Rows of the words in flat; those not met before are merged first."""
        if len(self.index) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self._forget_rare()
        before = len(self.index)
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := list(islice(reversed(self.index), len(self.index) - before))[::-1]:
            flat, at = self.merge(new)
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.chars += sum(map(len, new))
        met = np.bincount(rows, minlength=len(self.index))
        met[: len(self.met)] += self.met
        self.met = met
        return rows

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids. Control ids have no text, but part the bytes of a character that stand on either side."""
        ids = np.asarray(ids, np.int64)
        parts = np.split(ids, np.flatnonzero(self.control[ids])) if len(ids) else []
        parts = [q for p in parts if len(q := p[~self.control[p]])]
        raw = [gather(self.raw, self.raw_at, p)[0].tobytes() for p in parts]
        if raw and self.strips and self.spaced[parts[0][0]]:
            raw[0] = raw[0][1:]
        return "".join(r.decode("utf-8", "each_byte") for r in raw)


def gather(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contents of rows of a ragged array one after the other, and where each begins and ends."""
    size = at[rows + 1] - at[rows]
    ends = np.cumsum(size)
    to = np.concatenate([[0], ends])
    return flat[np.repeat(at[rows] - to[:-1], size) + np.arange(to[-1])], to


_LOADED: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model, built once in each worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceCodec(model)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    rest = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), values], names=[*rest, name])


def _parts(values, most: int = 1 << 20):
    """Runs of successive values, as (place of the first, values), of about `most` elements in all."""
    at, held, size = 0, [], 0
    for v in values:
        held.append(v)
        size += len(v)
        if size >= most:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))


def encode(docs: DataFrame, model: bytes, eos: bool = True, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of text_col as array<int>."""

    def run(batches):
        c = codec(model)
        for b in batches:
            for at, ids in _parts(c.encode(b.column(text_col).to_pylist(), eos)):
                yield _put(b.slice(at, len(ids)), ids_col, _lists(ids))

    return docs.mapInArrow(run, _with(docs.schema, ids_col, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """docs with the text of ids_col; null ids have the empty text."""

    def run(batches):
        c = codec(model)
        for b in batches:
            ids = b.column(ids_col)
            each = (c.decode(x.values.to_numpy()) if (x := ids[i]).is_valid else "" for i in range(len(b)))
            for at, texts in _parts(each):
                yield _put(b.slice(at, len(texts)), text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, _with(docs.schema, text_col, T.StringType()))


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of docs (doc_id, text): the ids with an end id and the text that they decode to.

    One pass, so a task has one worker with one codec, and hands on its results every million ids."""

    def run(batches):
        c = codec(model)
        for b in (part for whole in batches for part in slices(whole, "text")):
            for at, ids in _parts(c.encode(b.column("text").to_pylist())):
                cols = [b.column("doc_id").slice(at, len(ids)), pa.array([len(x) for x in ids], pa.int64()), _lists(ids), pa.array([c.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids array<int>, text string")


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """The query's columns, made batch by batch where the ids are, as these are several times the size of their digests."""
    names = [str(i) for i in range(codec(model).size)]

    def run(batches):
        c, sha = codec(model), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            texts = b.column("text").to_pylist()
            n, enc, dec = [], [], []
            for ids in c.encode(texts):
                n.append(len(ids))
                enc.append(sha(" ".join(map(names.__getitem__, ids.tolist()))))
                dec.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
