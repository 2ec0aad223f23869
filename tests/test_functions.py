import random

import pytest
from pyspark.sql import functions as F

from versicle.functions import arrays, clock, text, titles


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 50, 333)]
    got = values(spark, arrays.prefix_sums(F.col("a")), rows, "a array<int>")
    assert got == [[sum(a[:i]) for i in range(len(a))] for (a,) in rows]


def test_sentences_keep_offsets(spark):
    rng = random.Random(2)
    words = ["Mr.", "one", "two!", "«é»", "end.", "\n", " ", "?!", '"so."', "😀", "Dr. X"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))),) for _ in range(60)] + [("",), ("...",)]
    for (t,), spans in zip(rows, values(spark, text.sentence_spans(F.col("t")), rows, "t string")):
        assert all(t[s.start : s.stop] == s.text and s.text.strip() == s.text != "" for s in spans)
        assert all(a.stop <= b.start for a, b in zip(spans, spans[1:]))


def test_abbreviations_do_not_end_sentences(spark):
    [spans] = values(spark, text.sentence_spans(F.col("t")), [("Mr. Fox ran. Did he? Yes",)], "t string")
    assert [s.text for s in spans] == ["Mr. Fox ran.", "Did he?", "Yes"]


def test_words(spark):
    [w] = values(spark, text.word_tokens(F.col("t")), [(" The quick brown fox—lazy dog. ",)], "t string")
    assert w == ["The", "quick", "brown", "fox", "lazy", "dog."]
    pairs = {"Hello": "hello", "world!": "world", '"Quoted,"': "quoted", "Mr.": "mr", "don't": "don't", "1.": "1", "---": "", "«Éa»": "éa"}
    assert values(spark, text.normal_word(F.col("w")), [(w,) for w in pairs], "w string") == list(pairs.values())


def test_element_ids(spark):
    assert values(spark, text.element_id(F.col("n")), [(42,), (12345,), (-1,)], "n long") == ["mo_s_0042", "mo_s_12345", None]
    ids = [("mo_s_0042",), ("mo_s_12345",), ("mo_s_01",), (None,), ("mo_s_0042\n",)]
    assert values(spark, text.is_element_id(F.col("e")), ids, "e string") == [True, True, False, False, False]
    assert values(spark, text.element_number(F.col("e")), ids, "e string") == [42, 12345, None, None, None]


def test_paths(spark):
    row = spark.createDataFrame([("a/b/my_first file.MP3",)], "p string").select(text.basename(F.col("p")), text.stem(F.col("p")), text.suffix(F.col("p")), text.audio_mime(F.col("p")), text.slug(text.stem(F.col("p"))), text.stem_title(F.lit("chapter_01a o'neil 3d")))
    assert list(row.first()) == ["my_first file.MP3", "my_first file", ".mp3", "audio/mpeg", "my_first_file", "Chapter 01A O'Neil 3D"]


def test_clocks(spark):
    ms = [(0,), (31,), (123456,), (3723456,), (61050,), (500,), (3600000,)]
    assert values(spark, clock.smil_clock(F.col("m")), ms, "m long")[:3] == ["0.000s", "0.031s", "123.456s"]
    assert values(spark, clock.hms_clock(F.col("m")), ms, "m long")[3:] == ["01:02:03.456", "00:01:01.050", "00:00:00.500", "01:00:00.000"]
    assert values(spark, clock.parse_clock(F.col("c")), [("01:02:03.456",), ("02:03.456",), ("2.340s",), ("7",), ("x",)], "c string") == pytest.approx([3723.456, 123.456, 2.34, 7.0, None])
    with pytest.raises(Exception, match="negative clock"):
        values(spark, clock.smil_clock(F.col("m")), [(-1,)], "m long")
    assert values(spark, clock.to_ms(F.col("s")), [(0.0005,), (0.0025,), (1.2345,)], "s double") == [0, 2, 1234]
    seconds = {0.0005: "< 1ms", 0.35: "350ms", 15.234: "15.23s", 125.5: "2m 5.5s", 3665.0: "1h 1m 5s", -5.0: "< 1ms"}
    assert values(spark, clock.readable(F.col("s")), [(s,) for s in seconds], "s double") == list(seconds.values())


@pytest.mark.parametrize(("title", "normal"), [
    ("Ch. 1", "chapter 1"), ("Twenty-One", "21"), ("1st Chapter", "1 chapter"), ("Chapter XIV", "chapter 14"), ("Part One", "part 1"), ("", ""),
    ("Chapter Twenty-One: Dawn", "chapter 21 dawn"), ("Scene iv", "scene 4"), ("Prologue", "prologue"), ("Chapter", "chapter"), ("bk 02", "book 2"),
])
def test_normal_titles(title, normal):
    assert titles.normal_title(title) == normal


def test_numbers():
    assert [titles.roman(x) for x in ("xiv", "xxv", "invalid", "", "mix", "xl", "C")] == [14, 25, None, None, 1009, 40, 100]
    assert [titles.word_number(x) for x in ("twenty-one", "second", "forty two", "none", "")] == [21, 2, 42, None, None]


def test_sections(spark):
    rows = [("Colophon", "", None), ("x", "", "toc"), ("Chapter 1", "", None), ("", "‘Something long’ — Someone", None), ("Contentsof", "", None), ("The Cast", "Dramatis Personae", None), ("", "", "Cover"), ("All Rights Reserved", None, None)]
    got = values(spark, titles.section_reason(F.col("t"), F.col("p"), F.col("g")), rows, "t string, p string, g string")
    assert got == ["detected back-matter Colophon", "detected front-matter TOC", None, "detected front-matter Epigraph", None, "detected front-matter Dramatis Personae", "detected OPF guide/landmark 'cover'", "detected front-matter Copyright"]


def test_similarity_column_agrees(spark):
    rows = [("chapter 1", "1"), ("a", "a"), ("", "a"), ("title page", "credits"), ("one", "credits"), ("chapter 1 dawn", "chapter 1"), ("the big dawn", "big"), ("the long road", "the lang road"), ("abc", "xyz"), (None, "x")]
    got = values(spark, titles.similarity(F.col("a"), F.col("b")), rows, "a string, b string")
    assert got == pytest.approx([titles.similarity_of_normal(a or "", b) for a, b in rows])
    assert got[:7] == [0.95, 1.0, 0.0, 0.9, 0.7, 0.85, 0.8]


def test_rounding_is_half_even_on_the_binary_value(spark):
    rows = [(m / n,) for n in (16, 80, 3, 400, 2000, 7) for m in range(n)]
    got = spark.createDataFrame(rows, "x double").select(arrays.half_even(F.col("x"), 3)).collect()
    assert [r[0] for r in got] == [round(x, 3) for (x,) in rows]
    assert values(spark, clock.readable(F.col("s")), [(0.0625,), (59.125,)], "s double") == ["62ms", "59.12s"]


def test_private_use_characters_and_long_numbers(spark):
    t = "One \ue000 here. Dr. Who came! St. John."
    [r] = spark.createDataFrame([(t,)], "t string").select(text.sentence_spans(F.col("t"))).collect()
    assert [x["text"] for x in r[0]] == ["One \ue000 here.", "Dr. Who came!", "St. John."] and all(t[x["start"] : x["stop"]] == x["text"] for x in r[0])
    assert values(spark, text.element_number(F.col("v")), [("mo_s_12345678901234567890",), ("mo_s_1234567890123456789",), ("mo_s_0007",)], "v string") == [None, 1234567890123456789, 7]
