"""Benchmark decontamination over a positional inverted index.

Training postings are stored for the terms that decide the search only. Term counts over the training texts give the two
rarest terms of every benchmark window; postings of these are shifted by their offset in the window and intersected by
(document, item, alignment). What is left is compared word by word, which gives exact phrase matches; `proximity` takes
alignments that differ by no more than a slop.

Benchmark-side tables are broadcast only if the benchmark has at most BROADCAST_WORDS words (rows of a few longs, below
50 MB); beyond that the same joins shuffle.

Defined cases. Null or empty text on either side: no words, no windows, no hits. Null doc_id or item_id is an id like
any other, but null item_ids are not listed. Rows that repeat a doc_id are judged each on its own words. Items that
repeat an id count once. Ties between equally rare terms go by term hash and offset. Empty tables give no hits; further
columns are carried by `contamination` unless they bear the names it adds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, let, text_of, unboxed

WIDTH, BROADCAST_WORDS = 10, 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return benchmark.select(F.col(id_col).alias("item"), words(text_of(text_col)).alias("iw")).filter(F.size("iw") > 0).distinct()


def _terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, term) of every word, term as a 64-bit hash."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.transform(words(text_of(text_col)), lambda w: F.xxhash64(w))).alias("pos", "term"))


def seeds(docs: DataFrame, items: DataFrame, small: bool, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, iw, start, size, a, b, ta, tb): each window with the places and terms of its two rarest words.

    Windows with a word that no training text has are left out. A window of one word has b = a.
    """
    vocabulary = items.select(F.explode(F.transform("iw", lambda w: F.xxhash64(w))).alias("term")).distinct()
    counts = _terms(docs, id_col, text_col).join(_small(vocabulary, small), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    at = items.select("item", F.xxhash64("iw").alias("ih"), F.posexplode(F.transform("iw", lambda w: F.xxhash64(w))).alias("ipos", "term")).join(_small(counts, small), "term", "left")
    by_item = at.groupBy("item", "ih").agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("t"))
    size = F.least(F.size("t"), F.lit(width))
    windows = by_item.select("item", "ih", F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - size), lambda s: F.struct(s.alias("start"), size.alias("size"), F.array_sort(F.transform(F.slice("t", s + 1, size), lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"), x["ipos"].alias("ipos")))).alias("r")))).alias("w"))
    rare = lambda k: F.coalesce(F.get(F.col("w.r"), F.lit(k)), F.get(F.col("w.r"), F.lit(0)))
    out = windows.filter(F.get(F.col("w.r"), F.lit(0))["n"] > 0)
    return out.select("item", "ih", "w.start", "w.size", rare(0)["ipos"].alias("a"), rare(1)["ipos"].alias("b"), rare(0)["term"].alias("ta"), rare(1)["term"].alias("tb"))


def alignments(docs: DataFrame, found: DataFrame, small: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, item, ih, delta, ipos): postings of seed terms, shifted by their place in the item."""
    places = found.select("item", "ih", F.explode(F.array(F.struct(F.col("ta").alias("term"), F.col("a").alias("ipos")), F.struct(F.col("tb").alias("term"), F.col("b").alias("ipos")))).alias("s")).select("item", "ih", "s.*").distinct()
    postings = _terms(docs, id_col, text_col).join(_small(places, small), "term")
    return postings.select("doc", "item", "ih", (F.col("pos") - F.col("ipos")).alias("delta"), "ipos")


def _bench_words(items: DataFrame) -> int:
    return items.agg(F.sum(F.size("iw"))).first()[0] or 0


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _n_words, _n_hit and _items (sorted item ids as strings)."""
    items = item_words(benchmark)
    small = _bench_words(items) <= BROADCAST_WORDS
    found = seeds(docs, items, small, width, id_col, text_col)
    shifted = alignments(docs, found, small, id_col, text_col).groupBy("doc", "item", "ih", "delta").agg(F.collect_set("ipos").alias("at"))
    per_item = found.groupBy("item", "ih").agg(F.collect_list(F.struct("start", "size", "a", "b")).alias("windows")).join(items.withColumn("ih", F.xxhash64("iw")).withColumnRenamed("item", "item2"), "ih").filter(F.col("item").eqNullSafe(F.col("item2"))).drop("item2")
    per_item = per_item.select(F.col("item").alias("item3"), F.col("ih").alias("ih3"), "windows", "iw")
    both = shifted.join(_small(per_item, small), F.col("item").eqNullSafe(F.col("item3")) & (F.col("ih") == F.col("ih3")))
    both = both.withColumn("windows", F.filter("windows", lambda w: F.array_contains("at", w["a"]) & F.array_contains("at", w["b"]))).filter(F.size("windows") > 0)
    by_doc = both.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("item", "delta", "iw", F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["size"].alias("size"))).alias("windows"))).alias("_c"))
    out = boxed(docs, id=F.col(id_col), _dw=words(text_of(text_col)))
    out = out.join(by_doc, F.col("id").eqNullSafe(F.col("_doc")), "left")

    def matched(c: Column) -> Column:
        same = lambda i: F.coalesce(F.get(F.col("_dw"), i + c["delta"]) == F.get(c["iw"], i), F.lit(False))
        full = F.filter(c["windows"], lambda w: F.forall(F.sequence(w["start"], w["start"] + w["size"] - 1), same))
        return F.struct(c["item"].alias("item"), F.transform(full, lambda w: F.struct((w["start"] + c["delta"]).alias("s"), (w["start"] + c["delta"] + w["size"]).alias("e"))).alias("spans"))

    out = out.withColumn("_m", F.filter(F.transform(F.coalesce("_c", F.array()), matched), lambda m: F.size(m["spans"]) > 0))
    spans = F.array_sort(F.flatten(F.transform("_m", lambda m: m["spans"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(spans, start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(a["end"], s["s"]))).alias("n"), F.greatest(a["end"], s["e"]).alias("end")))["n"]
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("_m", lambda m: m["item"].cast("string")), lambda x: x.isNotNull())))
    n_hit = F.when(F.size("_m") > 0, total).otherwise(F.lit(0)).cast("long")
    items_of = F.when(F.size("_m") > 0, ids).otherwise(F.array().cast("array<string>"))
    return unboxed(out, docs.columns, _n_words=F.size("_dw").cast("long"), _n_hit=n_hit, _items=items_of)


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = 5, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, item, start, stop): word spans in which the two rarest terms of a window stand within slop of their distance.

    Postings of the first are met with those of the second in buckets of the alignment, never by all pairs of a term.
    """
    items = item_words(benchmark)
    small = _bench_words(items) <= BROADCAST_WORDS
    found = seeds(docs, items, small, width, id_col, text_col)
    shifted = alignments(docs, found, small, id_col, text_col).distinct()
    bucket = F.floor(F.col("delta") / (slop + 1))
    a = shifted.join(_small(found.select(F.col("item").alias("i2"), F.col("ih").alias("h2"), F.col("a").alias("p2"), "b").distinct(), small), F.col("item").eqNullSafe(F.col("i2")) & (F.col("ih") == F.col("h2")) & (F.col("ipos") == F.col("p2")))
    a = a.select("doc", "item", "ih", "delta", "ipos", "b", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k")).alias("x")
    b = shifted.withColumn("k", bucket).alias("y")
    met = a.join(b, F.col("x.doc").eqNullSafe(F.col("y.doc")) & F.col("x.item").eqNullSafe(F.col("y.item")) & (F.col("x.ih") == F.col("y.ih")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.b") == F.col("y.ipos")) & (F.abs(F.col("x.delta") - F.col("y.delta")) <= slop))
    p, q = F.col("x.delta") + F.col("x.ipos"), F.col("y.delta") + F.col("y.ipos")
    return met.select("x.doc", "x.item", F.least(p, q).alias("start"), (F.greatest(p, q) + 1).alias("stop")).distinct()


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, z, array_to_string(list_slice(w, i, i + z - 1), ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS z, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT z FROM bw), dw AS (
  SELECT doc_id, z, i, array_to_string(list_slice(w, i, i + z - 1), ' ') AS k
  FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, sizes WHERE len(w) >= z)
), hit AS (SELECT doc_id, i, dw.z, item_id FROM dw JOIN bw ON dw.z = bw.z AND dw.k = bw.k),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN its USING (doc_id)
"""
