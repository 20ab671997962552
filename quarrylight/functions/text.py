"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without retrieval signal, and generic category segments.
STOPWORDS = """
a an and are as at be but by for from i in is it me my of on or please some that the this to want with would you
looking im need want key requirement still exploring
hey hi really just browsing nothing specific mind quite yet ask about something one your call else more scratch forget
said before what matter matters things must have has needs after prefer ideally nope does dont doesnt
""".split()
GENERIC_SEGMENTS = ["clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry"]
MATERIALS = ["cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric"]
COLORS = ["black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange"]
NO_CATEGORY = "clothing item"
# The cascade of constraint kinds, tried in this order; a pattern or any of the words.
CONSTRAINT_KINDS = [
    ("budget", r"budget|(?:\$|<=|under)\s*\d"),
    ("material", "cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric"),
    ("color", "color|black|white|blue|red|pink|green"),
    ("size", "size|sizing|width|wide|narrow"),
    ("style", "department|style|fit|sleeve|neck"),
    ("use_case", "hiking|running|gym|winter|outdoor|work"),
]


def flatten_map(m: Column) -> Column:
    """``key value`` of every entry joined by spaces; a null value reads ``None``, a null map is empty."""
    entry = F.transform(F.map_entries(m), lambda e: F.concat_ws(" ", e["key"].cast("string"), F.coalesce(e["value"].cast("string"), F.lit("None"))))
    return F.coalesce(F.array_join(entry, " "), F.lit(""))


def flatten_array(a: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), " "), F.lit(""))


def flatten_scalar(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalise(text: Column) -> Column:
    """Lower case, runs of any white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Runs of a-z and 0-9 of two or more characters, without stopwords unless kept; duplicates stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    if keep_stopwords:
        return F.filter(found, lambda t: F.length(t) > 1)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def words(text: Column) -> Column:
    """What ``tokens`` finds and the empty and short pieces beside it, to be exploded and filtered by ``is_token``."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def is_token(word: Column) -> Column:
    """Which exploded words count: two characters or more and no stopword."""
    return (F.length(word) > 1) & ~word.isin(STOPWORDS)


def category_path(entries: Column) -> Column:
    """Entries split at commas and trimmed, without empty and generic segments; null gives an empty path."""
    parts = F.transform(F.flatten(F.transform(entries, lambda e: F.split(e, ","))), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(GENERIC_SEGMENTS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def coarse_label(path: Column) -> Column:
    """The last two segments of a path, in the order they stand."""
    last = F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(path) > 0, F.array_join(last, " ")).otherwise(NO_CATEGORY)


def parse_price(raw: Column) -> Column:
    """A price as double; null if absent, unparseable or not a number."""
    value = F.regexp_replace(raw.cast("string"), "[$,]", "").try_cast("double")
    return F.when(~F.isnan(value), value)


def searchable_text(title: Column, features: Column, details: Column, description: Column, categories: Column, store: Column) -> Column:
    """What the evaluator searches for materials and colours: present fields in this order, unchanged, joined by spaces."""
    return F.trim(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, features, details, description, categories, store)]))


def document_text(*fields: Column) -> Column:
    """Fields joined by one space each; an empty field leaves its space."""
    return F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])


def dense_text(title: Column, categories: Column, store: Column, features: Column, limit: int = 512) -> Column:
    """What an encoder reads: non-empty fields joined by `` | ``, cut to the limit."""
    return F.substring(F.concat_ws(" | ", *[F.nullif(f, F.lit("")) for f in (title, categories, store, features)]), 1, limit)


def flatten_values_map(m: Column) -> Column:
    """``key: value`` of entries whose value is neither null nor empty."""
    kept = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull() & ~e["value"].cast("string").isin("", "[]"))
    return F.coalesce(F.transform(kept, lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string"))), F.array().cast("array<string>"))


def flatten_values_array(a: Column) -> Column:
    kept = F.filter(a, lambda x: x.isNotNull() & (x.cast("string") != ""))
    return F.coalesce(F.transform(kept, lambda x: x.cast("string")), F.array().cast("array<string>"))


def clean_constraint(text: Column, limit: int = 180) -> Column:
    """Runs of white space as one space, signs stripped at the ends, cut to the limit, no space at the end."""
    return F.rtrim(F.substring(F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" -;,.\t\n")), 1, limit))


def first_word_of(text: Column, words: list[str]) -> Column:
    """The first of the words in the text, whole and in any case, lower-cased; null if none."""
    return F.nullif(F.lower(F.regexp_extract(text, rf"(?i)\b({'|'.join(words)})\b", 1)), F.lit(""))


def classify_constraint(text: Column) -> Column:
    """budget, material, color, size, style, use_case or feature: the first kind found."""
    low, out = F.lower(text), F.lit("feature")
    for kind, pattern in reversed(CONSTRAINT_KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def parse_label(message: Column) -> Column:
    """What follows ``looking for`` up to a comma, a full stop or the end, normalised; null if absent or 120 characters or more."""
    label = normalise(F.regexp_extract(message, r"(?i)looking for\s+(.+?)\s*(?:[.,]|$)", 1))
    return F.when((label != "") & (F.length(label) < 120), label)


def pretty_label(label: Column) -> Column:
    """Lower case without repeated words."""
    return F.array_join(F.array_distinct(F.split(F.lower(label), r"\s+")), " ")


def json_object(text: Column) -> Column:
    """From the first brace to the last; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def seed16(key: Column) -> Column:
    """A 16-bit seed from a string's crc32."""
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(0xFFFF))
