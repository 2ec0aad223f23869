"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds its measurements and one failure bit for each rule.
Policies are versioned masks over these bits, applied without going back to the text, and ablations are sums over
the distinct bit patterns.

Defined cases. Null or empty text: no words, all measurements 0, so `few_words` fails. Rows that repeat each get their
own ledger row. An empty table gives an empty ledger. Further columns are carried by `ledger` unless they bear the name
of a measurement, in which case the measurement replaces them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, let, text_of, unboxed

WINDOW = 8
#: Name and failure test of each rule; its place is its bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_text_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    ("shouting", "10 * n_shouts > 3 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: A document is kept under a policy if no bit of its mask is set.
POLICIES = {"base": BIT["few_words"] | BIT["repeated_words"], "2": (1 << len(RULES)) - 1}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_shouts")


def _covered(sorted_starts: Column, width: int) -> Column:
    """Length of the union of [p, p + width) over ascending p."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(sorted_starts) - 1),
        F.lit(0).cast("long"),
        lambda total, j: total + F.least(F.lit(width), F.coalesce(F.get(sorted_starts, j + 1) - F.get(sorted_starts, j), F.lit(width))),
    )


def _repeated(keys: Column, width: int) -> Column:
    """Words in windows whose key occurs twice or more; keys by window start. Sorts, so n log n in the text."""

    def starts(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["k"] == F.get(s, j)["k"]
        flagged = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get(s, i)["p"]),
        )
        return F.array_sort(F.filter(flagged, lambda p: p.isNotNull()))

    ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))
    return let(ordered, lambda s: let(starts(s), lambda p: _covered(p, width)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with MEASURES; columns of docs that bear these names are replaced."""
    out = boxed(docs, text=text_of(text_col))
    text = F.col("text")
    gone = lambda p: F.char_length(text) - F.char_length(F.regexp_replace(text, p, ""))
    out = out.withColumns({
        "words": F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != ""),
        "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
        "n_symbols": gone(r"[#*$%&|<>]+").cast("long"),
        "n_shouts": F.regexp_count(text, F.lit(r"[A-Z]{2,}[^\x00-\x7F]?[A-Z]*!!")).cast("long"),
        "word_chars": gone(f"[^{SPACE}]+").cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("words").cast("long"),
        "h": F.transform("words", lambda w: F.xxhash64(w)),
        "n_text_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WINDOW)]))
    out = out.withColumn("keys", F.when(F.size("h") >= WINDOW, windows))
    out = out.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), _repeated(F.col("keys"), WINDOW)).otherwise(F.lit(0)).cast("long"))
    return unboxed(out, docs.columns, **{m: F.col(m) for m in MEASURES})


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with MEASURES and fail_bits."""
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, test) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text_col).withColumn("fail_bits", total)


def passes(policy: str = "2") -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = "2") -> DataFrame:
    """(rule, n_failed, n_only): documents that fail a rule of the policy, and those that would be kept without it.

    The ledger is first summed to its distinct bit patterns, of which there are few whatever the corpus size.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask])
    r = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return r.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(F.lit(0))).alias("n_only"),
    )


def query(docs: DataFrame) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes().alias("kept"), "n_text_lines", "n_shouts", "fail_bits",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), dup AS (
  SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT win.doc_id, unnest(range(win.i, win.i + 8)) AS p FROM win JOIN dup USING (doc_id, k)) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_text_lines,
    CAST(len(regexp_extract_all(t, '[A-Z]{2,}[^\x00-\x7F]?[A-Z]*!!')) AS BIGINT) AS n_shouts
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id
), b AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (2 * n_dup_lines > n_text_lines)::INT
    + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::INT
    + 32 * (10 * n_shouts > 3 * n_words)::INT AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, n_text_lines, n_shouts, fail_bits FROM b
"""
