"""Packing, joins, repeats, classifier, tokens and the pipeline against plain Python, with the edge cases."""

import hashlib
import random

import numpy as np
import pytest
from conftest import DATA, needs_data
from pyspark.sql import functions as F

pytest.importorskip("versicle.llm")
from versicle.llm import packing, piece_codec, queries, rule_ensemble, shingle_join, stages, suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, source string, v long, s string"
EDGE = [(None, "a null id"), (1, None), (2, ""), (3, " \t\n"), (4, "x" * 30_000), (5, "same words here again"), (5, "same words here again"), (6, "\n" * 300), (7, "ÄÖ é " * 60)]


def docs(spark, rows):
    """Rows (doc_id, text), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "s", 7, "s") for d, t in rows], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def model():
    return queries.model_bytes()


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=model)


def repeats_by_hand(rows: list[tuple[int, str | None]], width: int = suffix_dedup.WIDTH) -> dict[int, tuple[int, int, int, str]]:
    """The query's result by a table of all windows."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        starts = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        out[doc] = (len(data), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_pieces_are_the_library_s(model, library):
    rng, c = random.Random(1), piece_codec.codec(model)
    parts = [*"aabcdehilnost   ▁\n\t.,éü中😀\x00_0", "the", "ing", "▁▁", "aaa", "<s>", "</s>", "<0x41>", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", None, " ", "   ", "a" * 3000, " " * 2000, "thethe" * 400, "中" * 300, "=-" * 500, "x y" * 20_000]
    for t, ids in zip(texts, c.encode(texts)):
        want = library.encode(t or "") + [2]
        assert ids.tolist() == want and c.decode(ids) == library.decode(want)
    for _ in range(500):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 12))]
        assert c.decode(np.array(ids, int)) == library.decode(ids)


def test_blocks_and_forgetting_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "BLOCK_CHARS", 50)
    monkeypatch.setattr(piece_codec, "CACHED_WORDS", 10)
    monkeypatch.setattr(piece_codec, "ROUNDS", 2)
    c = piece_codec.PieceCodec(model)
    texts = ["The quick brown fox  jumps over\nthe lazy dog " * 5, "", "supercalifragilistic" * 9, " lead"]
    assert [x.tolist() for x in c.encode(texts, eos=False)] == library.encode(texts)


def test_codec_query(spark, model, library):
    got = sorted((tuple(r) for r in piece_codec.digest(docs(spark, EDGE), model).collect()), key=str)
    want = []
    for d, t in EDGE:
        ids = library.encode(t or "") + [2]
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    assert piece_codec.digest(docs(spark, []), model).count() == 0
    back = piece_codec.decode(piece_codec.encode(docs(spark, EDGE), model).drop("text"), model)
    assert "source" in back.columns and sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t in EDGE)


def test_best_fit_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.randint(1, 40)
        sizes = sorted((rng.randint(1, length) for _ in range(rng.randint(0, 60))), reverse=True)
        room: list[int] = []
        for s in sizes:
            fit = min((r for r in room if r >= s), default=None)
            if fit is None:
                room.append(length - s)
            else:
                room[room.index(fit)] -= s
        rows = packing.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_packing_loses_nothing(spark, model, library):
    rows = [(i, t) for i, (_, t) in enumerate(EDGE)] + [(None, "null id")]
    packed = packing.pack(docs(spark, rows), model, length=64, shard_bytes=20_000).cache()
    parts = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r["doc_id"], []).append((r["offset"], r["ids"]))
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in parts.items()} == {d: library.encode(t or "") + [2] for d, t in rows}
    for r in packed.collect():
        cu, pos = r["cu_seqlens"], np.frombuffer(r["positions"], "<u2")
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 and len(r["ids"]) == 128 and len(cu) == len(r["doc_ids"]) + 1
        assert all(pos[a:b].tolist() == list(range(b - a)) for a, b in zip(cu, cu[1:])) and not pos[r["n_tokens"] :].any()
    assert packing.pack(docs(spark, []), model).count() == 0


def components(rows, size=4, percent=85):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split("[ \t\n\x0b\f\r]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(rng, n):
    """Documents drifting apart from a few bases, so that components are chains and stars."""
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))] for _ in range(6)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 40)}"
        if rng.random() < 0.3:
            bases[rng.randrange(6)] = words
        out.append((i, rng.choice([" ", "\n"]).join(rng.choice([str, str.upper])(w) for w in words)))
    return out


@pytest.mark.parametrize("few", [0, 2, 1 << 40])  # turns as long as they halve what is left, the default, and none
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(shingle_join, "FEW", few)
    rows = near_copies(random.Random(3), 150) + [(200 + i, t) for i, (_, t) in enumerate(EDGE)]
    got = sorted(tuple(r) for r in shingle_join.query(docs(spark, rows)).collect())
    assert got == sorted(components(rows)) and len({c for _, _, c in got}) < len(rows)


def test_components_edges(spark):
    got = sorted((tuple(r) for r in shingle_join.query(docs(spark, EDGE)).collect()), key=str)
    assert got == sorted(components(EDGE), key=str)
    assert shingle_join.query(docs(spark, [])).count() == 0


def test_packed_prefixes_are_small():
    rng = np.random.default_rng(6)
    prefixes = [rng.integers(0, 1 << 64, n, np.uint64) for n in (0, 1, 70_000, *[74] * 4000)]
    owners = [3, 5, 7, *range(20, 12_020, 3)]
    parts = shingle_join._parted(prefixes, owners)
    assert sum(len(t) + len(z) for _, t, z in parts) < 7 * sum(map(len, prefixes))  # a row of token, class and place took 20 and was sent twice
    got = set()
    for part, tokens, places in parts:
        owner, at = shingle_join._read_places(places)
        got |= set(zip((part << 32 | np.frombuffer(tokens, "<u4").astype(np.int64)).tolist(), owner.tolist(), at.tolist()))
    want = {(int(t >> 32) % shingle_join.PARTS << 32 | int(t) & 0xFFFFFFFF, o, min(i, 65535)) for o, p in zip(owners, prefixes) for i, t in enumerate(p.tolist())}
    assert got == want and shingle_join._parted([], []) == []


def test_shared_tokens(spark):
    rows = near_copies(random.Random(3), 150)
    rows += [(1000 + d, t) for d, t in rows[:50]] + [(2000 + i, t) for i, (_, t) in enumerate(EDGE)]
    g1, g2 = shingle_join.row_key()
    d = docs(spark, rows).repartition(5).select("doc_id", g1.alias("g1"), g2.alias("g2"), "text")
    rarity = np.zeros(1 << shingle_join.SKETCH_BITS, np.uint8)
    found = shingle_join.classes(d, spark.sparkContext.broadcast(rarity), 4, 85).persist()
    whose = {r["key"]: r["v"] for r in found.filter("part IS NULL").collect()}
    assert len(whose) == len(rows)
    met = {}
    for b, key, at in shingle_join.shared(found.filter("part IS NOT NULL")).collect():
        met.setdefault(b, set()).add((whose[key], at))
    want = {}
    for (_, t), s in zip(rows, shingle_join.shingle_sets([t for _, t in rows], 4)):
        if len(s) >= shingle_join.least_size(85):
            for at, token in enumerate(shingle_join._first(s, rarity[shingle_join._slots(s)], shingle_join.prefix_size(len(s), 85), 0).tolist()):
                want.setdefault((token >> 32) % shingle_join.PARTS << 32 | token & 0xFFFFFFFF, set()).add((shingle_join.class_of(s, t, 4)[0], at))
    several = lambda m: {b: c for b, c in m.items() if len({v for v, _ in c}) > 1}
    assert several(met) == several(want) != {}
    found.unpersist()


def test_near_duplicate_stage_takes_five_words(spark):
    rows = near_copies(random.Random(3), 150)
    want = {c for _, _, c in components(rows, 5, 80)}
    got = [r["doc_id"] for r in stages.near_duplicates(spark, docs(spark, rows), DATA).collect()]
    assert sorted(got) == sorted(want) and want < {c for _, _, c in components(rows)}


def test_prefixes_meet():
    for n in range(1, 300):
        for m in range(n, 300):
            need = -(-85 * (n + m) // 185)
            if 100 * n >= 85 * m and need <= n:
                assert shingle_join.prefix_size(n, 85) >= n - need + 1 and shingle_join.prefix_size(m, 85) >= m - need + 1


def test_suffix_sorting():
    rng = random.Random(4)
    for _ in range(60):
        segments = ["".join(rng.choice("ab\x00é") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 10))]
        want = sorted((s[i:], x, len(s) - i) for x, s in enumerate(segments) for i in range(len(s) + 1))
        sid, length, lcp = suffix_dedup.sort_collection(segments)
        assert list(zip(sid.tolist(), length.tolist())) == [w[1:] for w in want]
        common = [next((k for k, (p, q) in enumerate(zip(a[0], b[0])) if p != q), min(len(a[0]), len(b[0]))) for a, b in zip(want, want[1:])]
        assert lcp.tolist() == [0, *common]


@pytest.mark.parametrize("most", [1, 1000])
def test_repeats(spark, most):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(20, 260))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(lines)[rng.choice([0, 0, 7]) :] for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "xx" + "ab" * 100), (102, "é" * 120), (103, None), (104, ""), (105, rows[3][1]), (106, "q" * 99), (107, "q" * 100)]
    want = repeats_by_hand(rows)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, rows), most=most).collect()}
    for d, (n, removed, spans, kept) in want.items():
        r = got[d]
        assert (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) == (n, removed, spans, kept)
    assert any(v[1] for v in want.values())


def test_windows_of_a_frequent_anchor(spark, monkeypatch):
    """Segments of one anchor are compared by windows only where many share half of what is around it as well."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = text(60)
    rows = [(i, text(90) + line + text(90)) for i in range(40)]
    rows += [(40 + i, text(30) + rows[i][1][30 - i :] + text(20)) for i in range(12)]
    kept, store = [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df: kept.append(store(df)) or kept[-1])
    want = repeats_by_hand(rows)
    got = suffix_dedup.remove_repeats(docs(spark, rows), most=5).collect()
    assert {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in got} == {d: v[3] for d, v in want.items()} and any(v[1] for v in want.values())
    by_windows = lambda df: df.filter("k > 5").count()
    with_text = [df for df in kept if {"k", "seg"} <= set(df.columns)]
    assert by_windows(with_text[0]) > 5 and by_windows(with_text[-1]) < by_windows(with_text[0]) / 2


def test_repeats_edges(spark):
    got = suffix_dedup.query(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and {r["doc_id"]: r["n_removed"] for r in got}[4] == repeats_by_hand(EDGE[4:5])[4][1] == 29_999
    assert suffix_dedup.query(docs(spark, [])).count() == 0


def test_rules_compile_to_the_same_scores(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["word", "other", "### $$", "A!!", "x | y", "7"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    labels = spark.createDataFrame([(i, int("#" not in t)) for i, t in rows] + [(None, 1), (999, 0), (3, None)], "doc_id long, quality int")
    d = docs(spark, rows + EDGE)
    model = rule_ensemble.fit(d, labels)
    assert model.rules and model == rule_ensemble.fit(d.repartition(7), labels)
    stats = d.select(rule_ensemble.stats_of(F.coalesce("text", F.lit(""))).alias("s")).select("s.*").toPandas().to_numpy(float)
    scores = [r["_score"] for r in rule_ensemble.classify(d, model).collect()]
    assert scores == pytest.approx(model.scores(stats).tolist()) and all(0 <= s <= 1 for s in scores)
    assert rule_ensemble.query(docs(spark, []), labels).count() == 0
    assert {r["score"] for r in rule_ensemble.query(d, labels.limit(0)).collect()} == {0.5}
    assert len({r["score"] for r in rule_ensemble.query(d, labels.filter("quality = 1")).collect()}) == 1


@needs_data
def test_held_out_accuracy(spark):
    base = DATA.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = rule_ensemble.query(spark.read.parquet(f"{base}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id")
    n, right, clean, kept = got.agg(F.count("*"), F.sum(F.expr("int(predicted = quality)")), F.sum("quality"), F.sum(F.expr("int(predicted = 1 and quality = 1)"))).first()
    assert right >= 0.97 * n and kept >= 0.99 * clean


@needs_data
def test_pipeline(spark, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_text_operators import contaminated

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (name, f) in enumerate(pipeline.STAGES):
        before, d = d, f(spark, d, DATA).cache()
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        left = {r["doc_id"]: r["text"] for r in d.collect()}
        assert set(left) <= {r[0] for r in rows} and left
        assert i == 4 or d.columns == before.columns
        if i == 2:
            assert set(left) == {c for _, _, c in components(rows)}
        if i == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(left) == {k for k, v in contaminated(rows, items).items() if not v[4]}
        if i == 4:
            assert left == dict(rows)
            assert {r["doc_id"]: r["ids"] for r in d.collect()} == {k: library.encode(t or "") + [2] for k, t in rows}
    whole = {r["doc_id"]: r["n_tokens"] for r in pipeline.run(spark, DATA).collect()}
    assert whole == {r["doc_id"]: r["n_tokens"] for r in d.collect()}
