"""Surrogates for personal data.

Entities are found in every text and reduced to a canonical form, so that all mentions of one entity share it. Each
distinct entity gets a keyed surrogate of its own type: letters and digits keep their layout, names keep gender, script,
case and number of words, phones their country code, cards their first digit. Surrogates are checked against each other
and against the entities themselves; those that collide are drawn again, so different entities stay different
throughout the corpus and the same entity is the same everywhere.

Defined cases. Null text stays null, empty text empty, both without entities. Null doc_id is an id like any other. Rows
that repeat get the same text. When entities draw the same surrogate, the least canonical form keeps it. An empty table
gives an empty result; further columns are carried by `replace_entities` unless they bear the names it adds.
"""

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut, fingerprint, let, unboxed

_WORD = r"[\p{Lu}][\p{L}'’-]*"
MALE_TITLES, FEMALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "г-н"), ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Doña", "г-жа")
MALE_TITLES, FEMALE_TITLES, OTHER_TITLES = ((*t, *map(str.upper, t)) for t in (MALE_TITLES, FEMALE_TITLES, ("Dr", "Prof")))
TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kind and pattern. Each starts only where no such run is under way, so failing attempts don't add up, and all repeated
#: groups are bounded: a host name has at most 127 labels, and a matcher's stack does not grow with the text.
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"),
    ("ip6", rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
              r"|(?<![0-9.-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9-]|\.[0-9])|(?<![0-9+.-])0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9-])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("name", rf"(?<![\p{{L}}])(?:{TITLES})\.? {_WORD}(?: (?!(?:{TITLES})\b){_WORD})?"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
TILED = rf"(?s)(.*?)(?:({PATTERN})|\z)"
#: A text without any of these holds no entity.
MAYBE = rf"@|[0-9][0-9.() -]{{5}}|{_HEX}:(?::|{_HEX}:{_HEX}:)|[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}|(?:{TITLES})\.? [\p{{Lu}}]"
NAMES = {
    ("latin", "m"): "James John Robert Michael David William Thomas Daniel Paul Peter Simon Martin Oliver Victor Henry Samuel Julian Adrian Felix Leon".split(),
    ("latin", "f"): "Mary Anna Laura Sarah Emma Julia Clara Helen Alice Nora Eva Marta Sofia Irene Lucia Paula Diana Rosa Vera Ines".split(),
    ("latin", "s"): "Walker Turner Fischer Weber Moreau Lambert Navarro Castillo Marsh Holt Keller Brandt Girard Renaud Vidal Serrano Ashford Barlow Lindner Roussel".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Борис Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Ирина Наталья Светлана Вера Нина".split(),
    ("cyrillic", "s"): "Иваненко Петренко Шевчук Ткачук Мороз Савчук Бондарь Гончар Коваль Зимин".split(),
}
#: After so many attempts it is asked whether layouts of fixed length have room at all.
ATTEMPTS = 24


def _kind(m: Column) -> Column:
    out = F.when(m.contains("@"), F.lit("email"))
    for k, p in KINDS[1:-1]:
        out = out.when(m.rlike(rf"\A(?:{p})\z"), F.lit(k))
    return out.otherwise(F.lit("name"))


def _canonical(kind: Column, m: Column) -> Column:
    bare = F.regexp_replace(m, rf"\A(?:{TITLES})\.? ", "")
    script = F.when(bare.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "ip6"), F.lower(m)).when(kind == "ip", m).when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "name", F.concat_ws("|", script, F.lower(bare)))
        .when((kind == "phone") & (F.length(digits) == 10), F.concat(F.lit("1"), digits)).otherwise(digits)
    )


def _gender(m: Column) -> Column:
    """What a mention's title says of gender, or null."""
    return F.when(m.rlike(rf"\A(?:{'|'.join(MALE_TITLES)})[. ]"), "m").when(m.rlike(rf"\A(?:{'|'.join(FEMALE_TITLES)})[. ]"), "f")


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, i, kind, canon, gender, mention): the i-th entity of each text."""
    text = F.col(text_col)
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(TILED), F.lit(2)), lambda m, i: F.struct(i.alias("i"), m.alias("m"))), lambda x: x["m"] != "")
    rows = docs.filter(text.rlike(MAYBE)).select(F.col(id_col).alias("id"), fingerprint(text)[0].alias("h"), found.alias("e"))
    rows = rows.filter(F.size("e") > 0).dropDuplicates(["id", "h"]).select("id", "h", F.explode("e").alias("e")).select("id", "h", "e.i", F.col("e.m").alias("mention"))
    rows = rows.withColumn("kind", _kind(F.col("mention")))
    name = F.col("kind") == "name"
    return rows.withColumn("canon", _canonical(F.col("kind"), F.col("mention"))).withColumn("gender", F.when(name, _gender(F.col("mention"))))


def _layout(s: Column, noise: Column, letters: int = 26) -> Column:
    """s with each ASCII letter, of the first so many, and digit drawn anew; noise is 64 hex digits."""

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(noise, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int") + i.cast("int")
        pick = lambda first, n: F.chr(F.lit(ord(first)) + v % n)
        return F.when(c.rlike("[0-9]"), pick("0", 10)).when(c.rlike("[a-z]"), pick("a", letters)).when(c.rlike("[A-Z]"), pick("A", letters)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def _kept() -> Column:
    """How many first characters of the canonical form a surrogate keeps."""
    kind, canon = F.col("kind"), F.col("canon")
    return F.when(kind == "phone", F.greatest(F.length(canon) - 10, F.lit(0))).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)


def _full(every: DataFrame) -> bool:
    """Whether some layout of fixed length has fewer forms than its entities and as many surrogates need."""
    rest = F.substring(F.col("canon"), _kept() + 1, F.length("canon"))
    layout = F.regexp_replace(F.regexp_replace(rest, "[0-9]", "0"), "[A-Z]", "A")
    groups = every.filter(F.col("kind").isin("phone", "ssn", "card", "iban")).groupBy("kind", F.substring(F.col("canon"), F.lit(1), _kept()).alias("kept"), layout.alias("layout")).agg(F.count(F.lit(1)).alias("n"))
    forms = F.pow(F.lit(10.0), F.length(F.regexp_replace("layout", "A", ""))) * F.pow(F.lit(26.0), F.length(F.regexp_replace("layout", "0", "")))
    return not groups.filter(2 * F.col("n") > forms).isEmpty()


def _surrogate(key: str, attempt: int) -> Column:
    kind, canon = F.col("kind"), F.col("canon")

    def drawn(noise: Column) -> Column:
        byte = lambda i: F.conv(F.substring(noise, 2 * i + 1, 2), 16, 10).cast("int")
        tail = F.lit("") if not attempt else F.substring(noise, 50, 4 + attempt)
        at, dot = F.instr(canon, "@"), F.regexp_extract(canon, r"(\.[^.]+)$", 1)
        local, domain = F.substring(canon, F.lit(1), at - 1), F.substring(canon, at + 1, F.length(canon) - at - F.length(dot))
        keep = _kept()
        bits = F.split(canon, r"\|")
        gender = F.coalesce("gender", F.when(byte(5) % 2 == 0, "m").otherwise("f"))
        draw = lambda script, part, b: F.element_at(F.array(*map(F.lit, NAMES[script, part])), b % len(NAMES[script, part]) + 1)
        by_script = lambda f: F.when(F.get(bits, F.lit(0)) == "cyrillic", f("cyrillic")).otherwise(f("latin"))
        parts = 2 + attempt // 3 if attempt else 1  # grows without bound, so names never run out; bytes 4 and 5 are the given name's
        surname = by_script(lambda s: F.concat_ws("-", *[draw(s, "s", byte(i if i < 4 else 6 + (i - 4) % 26)) for i in range(parts)]))
        given = by_script(lambda s: F.when(gender == "m", draw(s, "m", byte(4))).otherwise(draw(s, "f", byte(4))))
        name = F.when(F.get(bits, F.lit(1)).contains(" "), F.concat_ws(" ", given, surname)).otherwise(surname)
        return (
            F.when(kind == "email", F.concat(_layout(local, noise), tail, F.lit("@"), _layout(domain, F.reverse(noise)), dot))
            .when(kind == "ip6", _layout(canon, noise, 6)).when(kind == "ip", F.concat_ws(".", byte(0) % 223 + 1, byte(1), byte(2), byte(3) % 254 + 1))
            .when(kind == "name", name)
            .otherwise(F.concat(F.substring(canon, F.lit(1), keep), _layout(F.substring(canon, keep + 1, F.length(canon)), noise)))
        )

    return let(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt))).cast("binary"), 256), drawn)


def _cut(df: DataFrame) -> DataFrame:
    """cut() in an eighth of the shuffle's partitions, as entities are few beside texts. For each file and its checksum
    Hadoop's local file system starts a process, which until it runs counts as another copy of the executor."""
    return cut(df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate), one row for each distinct entity; no surrogate is shared or equal to an entity."""
    # one person under several titles is one entity; titles that contradict each other say nothing
    known = F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender")
    every = _cut(found.groupBy("kind", "canon").agg(known))
    taken = every.select("kind", F.when(F.col("kind") == "name", F.initcap(F.element_at(F.split("canon", r"\|"), -1))).otherwise(F.col("canon")).alias("surrogate"))
    left, settled, n = every, None, every.count()
    for attempt in count():
        drawn = left.withColumn("surrogate", _surrogate(key, attempt))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(taken, ["kind", "surrogate"], "left_anti")
        first = _cut(first.select("kind", "canon", "surrogate"))
        settled = first if settled is None else settled.unionByName(first)
        n -= first.count()
        if not n:
            return settled
        taken = taken.unionByName(first.select("kind", "surrogate"))
        left = _cut(left.join(first, ["kind", "canon"], "left_anti"))
        if attempt == ATTEMPTS and _full(every):
            raise RuntimeError("more entities of one kind and layout than surrogates")


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention."""
    loud = mention == F.upper(mention)
    digits = F.regexp_replace(mention, "[^0-9A-Za-z]", "")
    digits_of = F.when((kind == "phone") & (F.length(digits) == F.length(surrogate) - 1), F.substring(surrogate, F.lit(2), F.length(surrogate))).otherwise(surrogate)
    nth = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    filled = F.array_join(F.transform(F.filter(F.split(mention, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(digits_of, nth(i), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(mention, rf"\A((?:{TITLES})\.? )", 1)
    bare = F.substring(mention, F.length(title) + 1, F.length(mention))
    return (
        F.when(kind == "email", F.when(loud & mention.rlike("[A-Z]"), F.upper(surrogate)).otherwise(surrogate)).when(kind == "ip", surrogate).when(kind == "ip6", F.when(mention.rlike("[A-F]"), F.upper(surrogate)).otherwise(surrogate))
        .when(kind == "name", F.concat(title, F.when((bare == F.upper(bare)) & (F.length(bare) > 1), F.upper(surrogate)).otherwise(surrogate)))
        .otherwise(filled)
    )


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten, and _entities: array<struct<kind, surrogate>> in text order."""
    found = _cut(entities(docs, id_col, text_col))
    known = surrogates(found, key)
    named = found.hint("merge").join(known.hint("merge"), ["kind", "canon"])
    by_doc = (
        named.withColumn("new", _rendered(F.col("kind"), F.col("mention"), F.col("surrogate")))
        .groupBy(F.col("id").alias("_id"), F.col("h").alias("_h2"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "kind", "new"))).alias("_e"))
    )
    out = boxed(docs, id=F.col(id_col), text=F.col(text_col), h=fingerprint(F.col(text_col))[0])
    out = out.join(by_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h2")), "left")
    pieces = F.regexp_extract_all("text", F.lit(TILED), F.lit(1))
    new = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_e"), i)["new"], F.lit("")))), "")
    found = F.coalesce(F.transform("_e", lambda e: F.struct(e["kind"].alias("kind"), e["new"].alias("surrogate"))), F.array())
    return unboxed(out, docs.columns, **{text_col: F.when(F.col("_e").isNull(), F.col("text")).otherwise(new), "_entities": found})


def query(docs: DataFrame, key: str = "surrogate key of this corpus") -> DataFrame:
    out = replace_entities(docs.select("doc_id", "text"), key)
    return out.select("doc_id", F.size("_entities").cast("long").alias("n_entities"), F.transform("_entities", lambda e: e["kind"]).alias("kinds"), "text")
