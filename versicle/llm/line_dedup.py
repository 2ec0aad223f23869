"""Line dedup: lines found in many documents stay in one of them only.

Lines are exploded with their normalised key, keys are hashed, documents are counted by hash, and texts are put
together again in line order without the lines over the threshold.

Defined cases. Null or empty text: one empty line, kept. Null doc_id: the row counts for no line and stays whole. Rows
that repeat a doc_id count as one document, and all of them lose the lines that it loses. Ties cannot arise: the largest doc_id that
holds a key is unique. Very long texts: work is in proportion to their lines. An empty table gives an empty result.
Further columns of any name are carried along by `dedup_lines`; those that bear the names it adds are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, fingerprint, text_of, unboxed

TRIM = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(TRIM)))


def _hash(key: Column) -> Column:
    a, b = fingerprint(key)
    return F.struct(a.alias("a"), b.alias("b"))


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(g1, g2, gone): the places, ascending, of the lines that a row loses; g1 and g2 are the row's fingerprint.

    Only ids, places and hashes are shuffled. A hot key is spread by its document ids until it has been counted by
    partial aggregates; the join back to its lines is a sort-merge join that AQE splits.
    """
    one, two = _row_key(id_col, text_col)
    keys = F.transform(F.split(text_of(text_col), "\n", -1), line_key)
    long = F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("at"), F.when(F.char_length(k) >= min_chars, _hash(k)).alias("key"))), lambda x: x["key"].isNotNull())
    held = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), one.alias("g1"), two.alias("g2"), F.explode(long).alias("line"))
    held = held.select("id", "g1", "g2", "line.at", F.col("line.key.a").alias("a"), F.col("line.key.b").alias("b"))
    counted = held.select("id", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
    hot = counted.filter(F.col("n_docs") >= min_docs).drop("n_docs")
    lost = held.hint("merge").join(hot.hint("merge"), ["a", "b"]).filter("id <> keeper")
    return lost.groupBy("g1", "g2").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return fingerprint(F.col(id_col).cast("string"), text_of(text_col))


def _without(lines: Column, gone: Column) -> Column:
    """lines without those at the ascending places gone: the runs between them, so in one pass."""
    before = lambda j: F.coalesce(F.get(gone, j - 1), F.lit(-1))
    runs = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(lines, before(j) + 2, F.coalesce(F.get(gone, j), F.size(lines)) - before(j) - 1))
    return F.flatten(runs)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten, and _n_lines and _n_dropped added."""
    one, two = _row_key(id_col, text_col)
    drops = repeated_lines(docs, min_chars, min_docs, id_col, text_col)
    joined = boxed(docs, g1=one, g2=two).join(drops, ["g1", "g2"], "left")
    text = F.col("row").getField(text_col)
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(_without(lines, F.col("gone")), "\n"))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return unboxed(joined, docs.columns, **{text_col: kept, "_n_lines": F.size(lines).cast("long"), "_n_dropped": n_dropped})


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT k.*, hot.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
