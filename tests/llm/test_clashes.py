"""Columns whose names clash with those the operators use inside, ids of other types, rows that repeat, adversarial words."""

import random

import pytest
from conftest import DATA, needs_data  # noqa: F401
from pyspark.sql import functions as F

pytest.importorskip("versicle.llm")
from versicle.llm import decontamination, line_dedup, packing, piece_codec, pii_surrogates, quality_rules, queries, rule_ensemble, shingle_join, stages, suffix_dedup  # noqa: E402

#: Every name that some operator gives to a column inside.
NAMES = (
    "row id g1 g2 gone key keys words lines line h a b c d e i k m n p s t v w x y z at term item iw ih ipos delta place total found kept shard "
    "_id _h _h2 _e _c _m _dw _doc _score _y _lines _drop _kept _words _keys _entities _n_lines _n_dropped _n_words _n_hit _items "
    "n_words n_shouts fail_bits n_shingles component_id ids n_tokens score predicted held_out"
).split()
LINE = "This is one line of a licence that many documents share word for word"
ROWS = [(i, f"{LINE}\nMr John Smith wrote to a{i}@mail.com about the number {i} and some more words that follow here\n" + "so it goes on " * i) for i in range(12)] + [(None, None), (20, ""), (3, "x" * 9000)]


def plain(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def wide(spark, rows=ROWS):
    return plain(spark, rows).select("*", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES))


def _benchmark(spark):
    return spark.createDataFrame([(1, "some more words that follow here so it goes on so it"), (2, None)], "item_id long, text string")


OPERATORS = {
    "op2": lambda s, d: quality_rules.ledger(d),
    "op4": lambda s, d: pii_surrogates.replace_entities(d, "key"),
    "op5": lambda s, d: decontamination.contamination(d, _benchmark(s)),
    "op8": lambda s, d: rule_ensemble.classify(d, rule_ensemble.Ensemble(0.5, [])),
    "op9": lambda s, d: line_dedup.dedup_lines(d),
    "op10": lambda s, d: piece_codec.encode(d, queries.model_bytes()),
    "op1": lambda s, d: __import__("versicle.llm.secret_scan", fromlist=["query"]).query(d),
    "op3": lambda s, d: packing.pack(d, queries.model_bytes()).select("n_tokens", "doc_ids", "cu_seqlens"),
    "op6": lambda s, d: shingle_join.query(d),
    "op7": lambda s, d: suffix_dedup.query(d),
    "quality": lambda s, d: stages.quality(s, d, DATA),
    "lines": lambda s, d: stages.lines(s, d, DATA),
    "near_duplicates": lambda s, d: stages.near_duplicates(s, d, DATA),
    "decontaminate": lambda s, d: stages.decontaminate(s, d, DATA),
    "tokens": lambda s, d: stages.tokens(queries.model_bytes())(s, d, DATA),
}


@needs_data
@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    want, got = (OPERATORS[name](spark, make(spark)) for make in (plain, wide))
    assert sorted(map(str, (tuple(r) for r in want.collect()))) == sorted(map(str, (tuple(r) for r in got.select(want.columns).collect())))
    carried = [c for c in got.columns if c in NAMES and c not in want.columns]
    assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in got.collect() for c in carried)
    if name in ("quality", "lines", "near_duplicates", "decontaminate"):
        assert got.columns == wide(spark).columns


@needs_data
def test_empty_stages(spark):
    for name in ("quality", "lines", "near_duplicates", "decontaminate", "tokens"):
        assert OPERATORS[name](spark, wide(spark, []).limit(0)).count() == 0


def test_string_ids(spark):
    d = plain(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    packed = packing.pack(d, queries.model_bytes())
    assert {x for r in packed.collect() for x in r["doc_ids"]} == {None} | {f"d{i}" for i in [*range(12), 20]}
    assert packing.unpack(packed).schema["doc_id"].dataType.simpleString() == "string"
    assert shingle_join.query(d).schema["component_id"].dataType.simpleString() == "string"
    assert piece_codec.digest(d, queries.model_bytes()).count() == len(ROWS)


def test_near_duplicates_are_rows(spark):
    words = [f"word{i}" for i in range(60)]
    text, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, text), (None, text + " more"), (2, text + " end"), (5, text + " five"), (5, other), (6, ""), (7, None), (8, other), (8, other)]
    out = stages.near_duplicates(spark, plain(spark, rows), DATA)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text), (5, other), (6, ""), (7, None)], key=str)


def test_hashes_of_long_words_differ(spark):
    morse, parity = "", "a"
    while len(parity) < 1024:  # sums of powers of two numbers cannot tell these apart
        parity += parity.translate(str.maketrans("ab", "ba"))
    morse = parity.translate(str.maketrans("ab", "ba"))
    rows = [(1, parity), (2, morse), (3, parity[:60]), (4, morse[:60])]
    assert sorted(map(tuple, shingle_join.query(plain(spark, rows)).collect())) == [(i, 1, i) for i in (1, 2, 3, 4)]


def test_lines_of_a_long_text(spark):
    rows = [(i, "\n".join(f"{LINE} with the number {k}" for k in range(20_000))) for i in range(6)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.query(plain(spark, rows)).collect()}
    assert got == {**{i: 20_000 for i in range(5)}, 5: 0}


def test_surrogates_of_odd_texts(spark):
    rows = [
        (1, "x@" + "a." * 500_000), (2, "call 555-123-4567 or 020 7946 0958 or 2001:db8::ff00:42:8329 or 2001:DB8:0:1:2:3:4:5 at 12:30:45"),
        (3, "Mr. John Smith"), (4, "then Dr. John Smith"), (5, "x@" + "ab." * 60 + "com"), (6, None), (7, ""),
    ]
    got = {r["doc_id"]: r for r in pii_surrogates.query(plain(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["kinds"] == ["phone", "phone", "ip6", "ip6"] and "12:30:45" in got[2]["text"]
    assert not any(x in got[2]["text"] for x in ("555-123-4567", "020 7946 0958", "2001:db8::ff00:42:8329", "2001:DB8:0"))
    first, second = got[3]["text"], got[4]["text"]
    assert first.removeprefix("Mr. ") == second.removeprefix("then Dr. ") != "John Smith"
    assert first.split()[1] in pii_surrogates.NAMES["latin", "m"] and got[5]["kinds"] == ["email"]
    assert got[6]["text"] is None and got[7]["text"] == ""


def test_repeats_go_by_row(spark):
    rng = random.Random(5)
    block, other = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    rows = [(1, block), (5, other + block), (5, "short text of another row " * 4 + "x"), (7, other), (7, other), (9, other[:120] + " and an end of its own")]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.query(plain(spark, rows)).collect()}
    assert {(1, 150, 0), (5, 300, 150), (7, 150, 150)} <= got
    assert (5, 105, 0) in got and (9, 142, 120) in got
