"""Secret scans with multipart credential linking.

Strong patterns (assigned secrets, access keys, hex strings) are reported wherever they stand. Weak candidates (key
identifiers, opaque strings, endpoints) are reported only if a part of another role lies within `scope` characters:
parts are dealt to buckets of that width within their document and joined on bucket and interval.

Defined cases. Null or empty text: no spans. Rows that repeat doc_id and text give the same spans each; rows that repeat
only the doc_id are scanned separately, by doc_id and text hash. Null doc_id is an id like any other. Matches that tie
in their start are listed in the order of KINDS. An empty table gives an empty result; other columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fingerprint, text_of

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
_KEY_ID = r"""((?i:client_?id|access_?key_?id|key_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+))"""
_ENDPOINT = r"((?:https?|s3|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://([A-Za-z0-9._:@/-]+))"
#: Kind, role, pattern (group 1 all, group 2 the value), least length of the value, weak, cheap test of a text.
KINDS = [
    ("assign", "secret", _ASSIGN, 12, False, r"(?i:password|passwd|secret|token|api_?key)"),
    ("access", "id", "((AKIA[A-Z0-9]+))", 18, False, "AKIA[A-Z0-9]"),
    ("hex", "secret", "(([0-9a-f]+))", 16, False, "[0-9a-f]{16}"),
    ("key_id", "id", _KEY_ID, 4, True, r"(?i:client_?id|access_?key_?id|key_?id|account_?id|user_?name)"),
    ("opaque", "secret", "(([A-Za-z0-9+/]+))", 20, True, "[A-Za-z0-9+/]{20}"),
    ("endpoint", "endpoint", _ENDPOINT, 4, True, "://"),
]
SCOPE = 200


def _pieces(text: Column, k: int) -> Column:
    """(kind, whole, match, ok) of the consecutive pieces 'what lies before a match, and the match' that make up a text."""
    kind, _, pattern, least, weak, test = KINDS[k]
    tiled = rf"(?s)(.*?)(?:{pattern}|\z)"
    whole, match, value = (F.regexp_extract_all(text, F.lit(tiled), F.lit(g)) for g in (0, 2, 3))
    mixed = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]") if kind == "opaque" else F.lit(True)
    rows = F.transform(
        F.arrays_zip(whole.alias("a"), match.alias("b"), value.alias("c")),
        lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.char_length(x["a"]).alias("whole"), F.char_length(x["b"]).alias("match"), ((F.char_length(x["c"]) >= least) & mixed(x["c"])).alias("ok")),
    )
    return F.when(text.rlike(test), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,whole:int,match:int,ok:boolean>>"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, kind, start, stop): every strong and weak part, in code points. Only texts that may hold one are cut up."""
    text = text_of(text_col)
    maybe = docs.filter(F.expr(" OR ".join(f"{text_col} RLIKE r'{k[5]}'" for k in KINDS)))
    rows = (
        maybe.select(F.col(id_col).alias("id"), fingerprint(text)[0].alias("h"), F.concat(*[_pieces(text, k) for k in range(len(KINDS))]).alias("p"))
        .filter(F.exists("p", lambda x: x["ok"]))
        .dropDuplicates(["id", "h"])
        .select("id", "h", F.explode("p").alias("p"))
        .select("id", "h", "p.*")
    )
    run = Window.partitionBy("id", "h", "kind").orderBy("i")
    return rows.withColumn("stop", F.sum("whole").over(run)).filter(F.col("ok") & (F.col("match") > 0)).select("id", "h", "kind", (F.col("stop") - F.col("match")).alias("start"), "stop")


def _buckets(df: DataFrame, margin: int, scope: int) -> DataFrame:
    at = lambda c: F.floor(c / scope)
    return df.withColumn("bucket", F.explode(F.sequence(at(F.col("start") - margin), at(F.col("stop") + margin))))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong parts, and the weak ones that overlap no strong part and have a part of another role within scope."""
    role = F.element_at(F.array(*[F.lit(k[1]) for k in KINDS]), F.col("kind") + 1)
    first_weak = sum(not k[4] for k in KINDS)
    found = found.withColumn("role", role)
    strong, weak = found.filter(F.col("kind") < first_weak), found.filter(F.col("kind") >= first_weak)
    w, p = _buckets(weak, 0, scope).alias("w"), _buckets(found, scope, scope).alias("p")
    same = F.col("w.id").eqNullSafe(F.col("p.id")) & (F.col("w.h") == F.col("p.h")) & (F.col("w.bucket") == F.col("p.bucket"))
    apart = F.greatest("w.start", "p.start") - F.least("w.stop", "p.stop")
    near = w.join(p, same & (F.col("w.role") != F.col("p.role")) & (apart <= scope) & (apart >= 0), "left_semi")
    s = _buckets(strong, 0, scope).alias("p")
    free = near.alias("w").join(s, same & (apart < 0), "left_anti")
    # a weak part lies in several buckets: all of them must be free, one of them near
    taken = _buckets(weak, 0, scope).alias("w").join(s, same & (apart < 0), "left_semi").select("id", "h", "kind", "start").distinct()
    keep = free.select("id", "h", "kind", "start", "stop", "role").distinct().alias("k").join(
        taken.alias("t"), F.col("k.id").eqNullSafe(F.col("t.id")) & (F.col("k.h") == F.col("t.h")) & (F.col("k.kind") == F.col("t.kind")) & (F.col("k.start") == F.col("t.start")), "left_anti"
    )
    return strong.unionByName(keep)


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): for each row of docs, its spans as array<struct<start, kind, stop>> in order."""
    spans = (
        linked(parts(docs, id_col, text_col), scope)
        .groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    )
    keyed = docs.select(id_col, fingerprint(text_of(text_col))[0].alias("h"))
    return keyed.join(spans, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select(id_col, F.coalesce("spans", F.array()).alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _kind_sql(k: int) -> str:
    kind, role, pattern, least, weak, _ = KINDS[k]
    tiled = "'" + rf"(?s)(.*?)(?:{pattern}|\z)".replace("'", "''") + "'"
    mixed = " AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')" if kind == "opaque" else ""
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, '{role}' AS role, {str(weak).lower()} AS weak, upto - length(m) AS start, upto AS stop FROM (
  SELECT *, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, {tiled}, 0)) AS w, unnest(regexp_extract_all(text, {tiled}, 2)) AS m, unnest(regexp_extract_all(text, {tiled}, 3)) AS v,
      generate_subscripts(regexp_extract_all(text, {tiled}, 0), 1) AS i FROM documents WHERE text IS NOT NULL)) WHERE length(v) >= {least}{mixed}"""


SQL = f"""WITH f AS ({" UNION ALL ".join(_kind_sql(k) for k in range(len(KINDS)))}),
s AS (
  SELECT * FROM f WHERE NOT weak
  UNION ALL SELECT * FROM f WHERE weak
    AND EXISTS (SELECT 1 FROM f p WHERE p.doc_id = f.doc_id AND p.role <> f.role AND greatest(f.start, p.start) - least(f.stop, p.stop) BETWEEN 0 AND {SCOPE})
    AND NOT EXISTS (SELECT 1 FROM f p WHERE p.doc_id = f.doc_id AND NOT p.weak AND greatest(f.start, p.start) < least(f.stop, p.stop))
), a AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) FILTER (NOT weak) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""
