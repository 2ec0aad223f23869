import random

import pytest
from pyspark.sql import functions as F

from versicle.operators import mapping, overlay, timeline, wordmatch

SAMPLE = [(31, 2014), (2295, 5360), (5741, 9868), (10188, 12192), (12252, 15037), (15337, 19104), (19464, 22670), (23031, 23732)]
CLIPS = [(0, 2295), (2295, 5741), (5741, 10188), (10188, 12252), (12252, 15337), (15337, 19464), (19464, 23031), (23031, 23732)]


def rows_of(df, *columns, order="pos"):
    return [tuple(r[c] for c in columns) for r in df.orderBy(order).collect()]


def test_continuous_clips(spark):
    t = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(SAMPLE)], "b int, pos int, start_ms long, end_ms long")
    assert rows_of(timeline.clips(t, ["b"]), "clip_start", "clip_end") == CLIPS
    assert rows_of(timeline.clips(t, ["b"], continuous=False), "clip_start", "clip_end") == SAMPLE
    d = {r["b"]: (r["duration_ms"], r["par_count"], r["clock"]) for r in timeline.durations(t.withColumn("book", F.lit(0)), ["book"], "b").collect()}
    assert d == {1: (23732, 8, "00:00:23.732"), None: (23732, 8, "00:00:23.732")}


def test_numbers_run_over_chapters(spark):
    rng = random.Random(4)
    rows = [(b, c, p) for b in "xy" for c in rng.sample(range(5000), 40) for p in range(rng.randint(1, 5))]
    got = timeline.number_in_book(spark.createDataFrame(rows, "b string, c int, p int"), ["b"], "c", "p").collect()
    for b in "xy":
        assert [r["number"] for r in sorted((r for r in got if r["b"] == b), key=lambda r: (r["c"], r["p"]))] == list(range(1, sum(r[0] == b for r in rows) + 1))


def test_gaps_against_a_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for g in range(40):
        n, at, spans, chars = rng.randint(1, 12), 0.0, [], []
        for _ in range(n):
            at += rng.random() * 3
            spans.append((at, at + rng.random() * 2) if rng.random() < 0.5 else None)
            chars.append(rng.randint(0, 60))
        duration = rng.choice([at + 5, at / 2])
        rows += [(g, i, *(s or (None, None)), c, duration) for i, (s, c) in enumerate(zip(spans, chars))]
        left, i, out = 0.0, 0, []
        while i < n:
            if spans[i]:
                a, b = spans[i]
                left = max(b, a + 0.05)
                out.append((a, left))
                i += 1
                continue
            j = next((k for k in range(i, n) if spans[k]), n)
            right = spans[j][0] if j < n else duration if duration > left else left + 2.0 * (j - i)
            sizes = [max(1, c) for c in chars[i:j]]
            room, at2 = max((j - i) * 0.05, right - left), left
            for z in sizes:
                step = max(z / sum(sizes) * room, 0.05)
                out.append((at2, at2 + step))
                at2 += step
            i = j
        want[g] = out
    t = timeline.interpolate_gaps(spark.createDataFrame(rows, "g int, pos int, start_s double, end_s double, chars int, duration_s double"), ["g"])
    found = t.orderBy("pos").collect()
    for g, out in want.items():
        got = [(r["s_start"], r["s_end"]) for r in found if r["g"] == g]
        assert [x for p in got for x in p] == pytest.approx([x for p in out for x in p])


def test_clamp(spark):
    t = spark.createDataFrame([(1, 0, 0, 500, 2000), (1, 1, 400, 400, 2000), (1, 2, 100, 5000, 2000), (1, 3, 10, 20, 2000)], "g int, pos int, start_ms long, end_ms long, duration_ms long")
    assert rows_of(timeline.clamp(t, ["g"]), "start_ms", "end_ms") == [(0, 500), (500, 550), (550, 2000), (2000, 2050)]


def test_violations(spark):
    good = ("a", "t", 0, 10, 1.0)
    cases = {1: ("", "t", 0, 10, 1.0), 3: ("b", None, 10, 20, 1.0), 4: ("b", "t", None, 20, 1.0), 5: ("b", "t", -5, -1, 1.0), 6: ("b", "t", 10, 10, 1.0), 8: ("b", "t", 5, 20, 1.0), 9: ("b", "t", 10, 20, None), 2: ("a", "t", 10, 20, 1.0)}
    rows = [(k, 0, i, *e) for k, bad in cases.items() for i, e in enumerate((good, bad))]
    t = spark.createDataFrame(rows, "book int, ch int, pos int, element_id string, text string, start_ms long, end_ms long, confidence double")
    found = timeline.violations(t, ["book"], "ch")
    first = {r["book"]: r["rule_no"] for r in timeline.first_violation(found, ["book"], "ch").collect()}
    assert first == {k: k for k in cases}
    assert 8 not in {r["rule_no"] for r in timeline.violations(t, ["book"], "ch", allow_overlap=True).collect()}


def test_chapters_by_title():
    chapters = [("Contents", "toc"), ("Chapter 1", None), ("Dramatis Personae", "cast"), ("Chapter 2", None), ("Timeline", "back")]
    pairs, skipped = mapping.subsequence(chapters, ["Chapter One", "Chapter Two"])
    assert pairs == [(1, 0), (3, 1)] and [j for j, _ in skipped] == [0, 2, 4]
    pairs, skipped = mapping.subsequence([("Title", None), ("Contents", "toc"), ("Part 1", None)], ["Opening Credits", "Part One"])
    assert pairs == [(0, 0), (2, 1)] and skipped == [(1, "toc")]
    assert mapping.subsequence([("a", None)], []) == ([], [(0, "empty collection")])


def test_map_units(spark):
    c = spark.createDataFrame([(1, 0, "Contents", "", None), (1, 1, "Chapter 1", "", None), (2, 0, "x", "", None), (2, 1, "y", "", None)], "book_id int, chapter_pos int, title string, preview string, guide_type string")
    u = spark.createDataFrame([(1, 0, "Chapter One"), (2, 0, "Chapter 7"), (2, 1, "Chapter 8")], "book_id int, unit_pos int, title string")
    assert sorted(map(tuple, mapping.map_units(c, u).collect())) == [(1, 1, 0), (2, 0, 0), (2, 1, 1)]
    with pytest.raises(Exception, match="differ"):
        mapping.require_matched(mapping.positional(c, u, ["book_id"], "chapter_pos", "unit_pos"), "chapter_pos", "unit_pos").collect()
    swap = spark.createDataFrame([(2, 0, 1), (2, 1, 0)], "book_id int, chapter_index int, unit_index int")
    assert sorted(map(tuple, mapping.map_units(c, u, manual=swap).collect())) == [(2, 0, 1), (2, 1, 0)]


def test_skip_list(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    s = spark.createDataFrame([(" b ",), ("",)], "id string")
    assert sorted(r["id"] for r in mapping.without(c, s).collect()) == ["a", "c"]


def heard(spark, words):
    return spark.createDataFrame([(1, i, w, a, b) for i, (w, a, b) in enumerate(words)], "ch int, heard_pos long, word string, start_s double, end_s double")


def sentences(spark, *texts, duration=100.0):
    return spark.createDataFrame([(1, i, t, duration) for i, t in enumerate(texts)], "ch int, pos long, text string, duration_s double")


def test_aligned_sentences(spark):
    words = [(w, 0.1 + 0.4 * i, 0.4 + 0.4 * i) for i, w in enumerate("the quick brown fox".split())] + [(w, 2.0 + 0.3 * i, 2.3 + 0.3 * i) for i, w in enumerate("jumps over lazy dogs".split())]
    out = wordmatch.align_sentences(sentences(spark, "The quick brown fox.", "Jumps over lazy dogs!"), heard(spark, words), ["ch"])
    assert rows_of(out, "start_ms", "end_ms", "confidence") == [(100, 1600, 1.0), (2000, 3200, 1.0)]


def test_aligned_with_gaps(spark):
    out = wordmatch.align_sentences(sentences(spark, "one two", "never said", "three four", duration=9.0), heard(spark, [("one", 0.5, 1.0), ("two", 1.0, 1.9), ("three", 4.0, 5.0), ("four", None, None)]), ["ch"])
    (a, b, c) = rows_of(out, "start_ms", "end_ms", "confidence")
    assert a == (500, 1900, 1.0) and b == (1900, 4000, 0.0) and c == (4000, 5000, 1.0)


def test_misheard_word_keeps_the_rest():
    assert wordmatch.match_sequences(["a", "b", "", "c"], ["a", "x", "c"]) == [(0, 0), (3, 2)]


def test_slices(spark):
    seg = spark.createDataFrame([(1, 0, 0, 6, "Hello "), (1, 1, 6, 9, "you"), (1, 2, 9, 20, "! How now.")], "b int, seg_pos int, seg_start int, seg_end int, text string")
    rng = spark.createDataFrame([(1, "s1", 0, 10), (1, "s2", 11, 19)], "b int, element_id string, char_start int, char_end int")
    plan = overlay.slice_plan(seg, rng, ["b"])
    assert sorted((r["seg_pos"], r["element_id"], r["from"], r["to"], r["is_first"]) for r in plan.collect()) == [(0, "s1", 0, 6, True), (1, "s1", 0, 3, False), (2, "s1", 0, 1, False), (2, "s2", 2, 10, True)]
    marked = rows_of(overlay.wrap_segments(seg, plan, ["b"], "c"), "markup", order="seg_pos")
    assert marked == [('<span id="s1">Hello </span>',), ('<span class="c">you</span>',), ('<span class="c">!</span> <span id="s2">How now.</span>',)]


def test_id_checks(spark):
    tl = spark.createDataFrame([(1, "a"), (1, "b")], "k int, element_id string")
    ids = spark.createDataFrame([(1, "a"), (1, "mo_s_0001"), (2, "b")], "k int, element_id string")
    assert [r["element_id"] for r in overlay.unknown_ids(tl, ids, ["k"]).collect()] == ["b"]
    assert sorted(r["element_id"] for r in overlay.colliding_ids(ids, tl, ["k"]).collect()) == ["a", "mo_s_0001"]


def test_manifest(spark):
    p = spark.createDataFrame([(1, 0, "x/a b.mp3"), (1, 1, "y/a b.m4b"), (1, 2, "a_b_1.xyz")], "k int, pos int, path string")
    used = spark.createDataFrame([(1, "a_b")], "k int, item_id string")
    assert rows_of(overlay.manifest_items(p, ["k"], used), "item_id", "media_type") == [("a_b_1", "audio/mpeg"), ("a_b_2", "audio/mp4"), ("a_b_1_1", "audio/mpeg")]
    smil = spark.createDataFrame([(1, "s1", "c1", "t/x.xhtml"), (1, "s2", "zz", "t/y.xhtml"), (1, "s3", "q", "r/w.xhtml")], "k int, smil_id string, chapter_id string, xhtml_path string")
    items = spark.createDataFrame([(1, "c1", "p.xhtml", "application/xhtml+xml"), (1, "i2", "t/y.xhtml", "application/xhtml+xml"), (1, "i3", "w.xhtml", "application/xhtml+xml")], "k int, item_id string, href string, media_type string")
    assert sorted((r["smil_id"], r["item_id"]) for r in overlay.link_overlays(smil, items, ["k"]).collect()) == [("s1", "c1"), ("s2", "i2"), ("s3", "i3")]
    links = spark.createDataFrame([(1, "a.xhtml"), (1, "gone.xhtml")], "k int, src string")
    files = spark.createDataFrame([(1, "a.xhtml"), (1, "titlepage.xhtml")], "k int, path string")
    assert [tuple(r) for r in overlay.dead_links(links, files, ["k"]).collect()] == [(1, "gone.xhtml", "titlepage.xhtml")]
    css = spark.createDataFrame([("p {}  ",), (".-epub-media-overlay-active {}",)], "c string").select(overlay.active_style(F.col("c"))).collect()
    assert css[0][0].startswith("p {}\n\n.-epub") and css[1][0] == ".-epub-media-overlay-active {}"


def test_playlist(spark):
    p = timeline.clips(spark.createDataFrame([(1, 0, 1200, 3500, "s1"), (1, 1, 5000, 8200, "s2")], "k int, pos int, start_ms long, end_ms long, element_id string"), ["k"])
    [r] = overlay.playlist(p.withColumn("text_ref", F.lit("a&b.xhtml")).withColumn("audio_src", F.lit("a.mp3")), ["k"]).collect()
    assert '<par id="par_0001"><text src="a&amp;b.xhtml#s1"/><audio src="a.mp3" clipBegin="0.000s" clipEnd="5.000s"/></par>\n<par id="par_0002">' in r["smil"]
