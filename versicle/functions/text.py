"""Sentences, words, ids and paths as column expressions. Offsets are code points, ends exclusive."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, prefix_sums

BLANK = r" \t\n\r\f"
#: The stop after these does not end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "Mme", "Mlle")


def _tile(abbreviations: tuple[str, ...]) -> str:
    """A sentence with the separators before it, so that the matches tile the text."""
    on = rf"(?:(?<=\b(?:{'|'.join(abbreviations)}))\.[^.!?]*+)*+" if abbreviations else ""
    return rf"""[.!?{BLANK}]*+[^.!?{BLANK}][^.!?]*+{on}(?:[.!?]+["']?|\z)"""


def sentence_spans(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """array<struct<start, stop, text>> of a text's sentences."""
    def cores(tiles: Column) -> Column:
        def span(m: Column, i: Column, ends: Column) -> Column:
            core = F.ltrim(m, F.lit(".!? \t\n\r\f"))
            start = F.get(ends, i) + F.char_length(m) - F.char_length(core)
            clean = F.rtrim(core, F.lit(" \t\n\r\f"))
            return F.struct(start.alias("start"), (start + F.char_length(clean)).alias("stop"), clean.alias("text"))

        return let(prefix_sums(F.transform(tiles, F.char_length)), lambda before: F.transform(tiles, lambda m, i: span(m, i, before)))

    return let(F.regexp_extract_all(text, F.lit(_tile(abbreviations)), F.lit(0)), cores)


def word_tokens(text: Column) -> Column:
    """Words between blanks and em or en dashes."""
    return F.filter(F.split(text, r"[\s\x{2014}\x{2013}]+", -1), lambda w: w != "")


def normal_word(word: Column) -> Column:
    """Lower case without leading and trailing characters other than letters, digits and underscores."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def element_id(number: Column, prefix: str = "mo_s_") -> Column:
    return F.when(number >= 0, F.format_string(f"{prefix}%04d", number))


def is_element_id(value: Column, prefix: str = "mo_s_") -> Column:
    return F.coalesce(value.rlike(f"^{prefix}[0-9]{{4,}}\\z"), F.lit(False))


def element_number(value: Column, prefix: str = "mo_s_") -> Column:
    return F.when(is_element_id(value, prefix), F.substring(value, len(prefix) + 1, 40).try_cast("long"))


def slug(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9_-]", "_")


def href_path(href: Column) -> Column:
    return F.trim(F.split_part(href, F.lit("#"), F.lit(1)))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def relative(path: Column, folder: Column) -> Column:
    """path as seen from folder, both from one root; '' and '.' are the root."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    a, b = parts(folder), parts(path)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    shared = F.when(differs == 0, F.size(same)).otherwise(differs - 1)
    out = F.concat(F.repeat(F.lit("../"), F.size(a) - shared), F.array_join(F.slice(b, shared + 1, F.greatest(F.size(b), F.lit(1))), "/"))
    return F.when(out == "", ".").otherwise(F.regexp_replace(out, r"(?<=\.\.)/\z", ""))


def suffix(path: Column) -> Column:
    """Last extension with its dot, lower case, or ''."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)\z", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+\z", "")


def stem_title(path: Column) -> Column:
    """A title from a file name: underscores are blanks, each run of letters starts with a capital."""
    return F.array_join(F.transform(F.regexp_extract_all(F.replace(stem(path), F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.char_length(x))))), "")


#: File extension to MIME type.
AUDIO_MIME = {
    ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".m4b": "audio/mp4", ".mp4": "audio/mp4", ".aac": "audio/mp4",
    ".ogg": "audio/ogg", ".oga": "audio/ogg", ".wav": "audio/wav",
}


def audio_mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in AUDIO_MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("audio/mpeg"))
