"""What a customer's turn says: predicates, segments, constraints and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Wording of turns.
EMPTY_TURN = (
    r"(?i)(don'?t have (?:an additional |a )?preference|no (?:strong )?(?:feelings|preference)|"
    r"does ?n'?t matter|no opinion|use your judg?ment|your call|up to you|"
    r"not quite (?:right)?|nothing (?:else|more)(?: to add)?|"
    r"ask me (?:about )?(?:one |some)?(?:thing|specific)|^\s*nope\b)"
)
OVERRIDE = r"(?i)\b(actually|instead|ignore my earlier|ignore what i said|change to|rather than|scratch that|forget what i said|on second thought)\b"
SLOT_OVERRIDE = r"\b(actually|instead|change to|not|rather|never mind|scratch that)\b"
LEAD_MARKER = (
    r"(?i)^.{0,80}?\b(?:requirement is|requirements are|key requirement|what matters is|what i need is|"
    r"things that matter to me are|matters? to me (?:is|are)|needs? to be|must (?:have|be)|has to be|have to be|"
    r"i(?:'m| am)?\s*(?:want|need|after|looking for|really want)|prefer(?:ably)?|ideally|specifically)\b\s*:?\s*"
)
SEGMENT = r";|(?<=[a-z0-9])\.\s+(?=[A-Z])"
SUBSPLIT = r"(?i)\band\b"
EDGE = ".,;:!? "
MIN_PHRASE_CHARS = 8

# Slot patterns with the group that holds the value, and their weights.
SLOTS = {
    "size": (r"\b(size\s+[xs|s|m|l|xl|xxl|\d.]+)\b", 1, 0.5),
    "price_max": (r"\b(under|below|less than|\$)\s*\$?(\d+(?:\.\d{1,2})?)\b", 2, 0.5),
    "price_min": (r"\b(above|over|more than|at least)\s*\$?(\d+(?:\.\d{1,2})?)\b", 2, 0.5),
    "store": (r"\b(nike|adidas|under armour|levis|zara|puma|calvin klein)\b", 1, 0.6),
    "color": (r"\b(black|white|red|blue|green|yellow|pink|purple|brown|navy|gold|silver)\b", 1, 0.5),
    "main_category": (r"\b(clothing|shoes|jewelry|watches|handbags|boots|sneakers|dresses)\b", 1, 0.3),
    "min_rating": (r"\b(\d(?:\.\d)?)\s*(?:stars?|rated|rating)\b", 1, 0.3),
}
NUMERIC_SLOTS = ["price_max", "price_min", "min_rating"]
EXPLICIT_SLOTS = ["size", "color", "store"]
BROWSING_WORDS = ["looking for", "recommend", "ideas", "something", "cozy", "style", "outfit", "casual", "formal", "suggestions", "what goes with", "trending"]
# Weights of filled slots in the specificity score, and its threshold.
SPECIFICITY = {"size": 0.5, "color": 0.5, "material": 0.5, "store": 0.6, "main_category": 0.3, "price_max": 0.5, "price_min": 0.5, "min_rating": 0.3}
SPECIFIC_ENOUGH, POOL_TOO_LARGE = 0.5, 500


def is_empty_turn(message: Column) -> Column:
    return message.rlike(EMPTY_TURN)


def is_override(message: Column) -> Column:
    """An earlier preference is revoked, as retrieval reads it."""
    return message.rlike(OVERRIDE)


def is_slot_override(message: Column) -> Column:
    """The same as the slot tracker reads it, with a list of its own."""
    return F.lower(message).rlike(SLOT_OVERRIDE)


def edge_stripped(text: Column) -> Column:
    return F.trim(F.btrim(text, F.lit(EDGE)))


def without_label(message: Column, label: Column) -> Column:
    """Every occurrence of the label, in any case, as a space; unchanged where there is no label."""
    # A label may hold \E, which would end the quotation.
    quoted = F.concat(F.lit("(?i)\\Q"), F.replace(label, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(label.isNull() | (label == ""), F.trim(message)).otherwise(F.regexp_replace(F.trim(message), quoted, F.lit(" ")))


def segments(text: Column) -> Column:
    """Pieces between semicolons and sentence ends, stripped, of three characters or more."""
    return F.filter(F.transform(F.split(text, SEGMENT), lambda s: F.trim(edge_stripped(F.trim(s)))), lambda s: F.length(s) >= 3)


def lead_stripped(segment: Column) -> Column:
    """The segment without the clause that announces it."""
    return edge_stripped(F.regexp_replace(segment, LEAD_MARKER, ""))


def preferred(parts: Column) -> Column:
    """Each segment in its stripped form if that has three characters or more, in order, without repeats."""
    return F.array_distinct(F.transform(parts, lambda s: F.when(F.length(lead_stripped(s)) >= 3, lead_stripped(s)).otherwise(s)))


def candidates(parts: Column) -> Column:
    """Every form of each segment for phrase evidence: itself, stripped, and its pieces around ``and``."""

    def forms(s: Column) -> Column:
        bare = lead_stripped(s)
        stripped = F.when((bare != s) & (F.length(bare) >= 3), F.array(bare)).otherwise(F.array().cast("array<string>"))
        base = F.when(bare != "", bare).otherwise(s)
        pieces = F.filter(F.transform(F.split(base, SUBSPLIT), edge_stripped), lambda p: F.length(p) >= 4)
        return F.concat(F.array(s), stripped, F.when(base.rlike(SUBSPLIT), pieces).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(parts, forms)))


def slot(message: Column, name: str) -> Column:
    """One slot's value in the lower-cased message; numbers as double; null if absent."""
    pattern, group, _ = SLOTS[name]
    value = F.nullif(F.regexp_extract(F.lower(message), pattern, group), F.lit(""))
    return value.cast("double") if name in NUMERIC_SLOTS else value


def slots(message: Column) -> dict[str, Column]:
    return {name: slot(message, name) for name in SLOTS}


def constraint_score(found: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, value in found.items():
        total = total + F.when(value.isNotNull(), F.lit(SLOTS[name][2])).otherwise(F.lit(0.0))
    return F.round(total, 6)


def intent(message: Column, found: dict[str, Column]) -> dict[str, Column]:
    """track, confidence and score of a turn."""
    score = constraint_score(found)
    explicit = sum((found[n].isNotNull().cast("int") for n in EXPLICIT_SLOTS), F.lit(0))
    low = F.lower(message)
    browsing = F.lit(False)
    for word in BROWSING_WORDS:
        browsing = browsing | low.contains(word)
    direct = (explicit > 0) | ((score >= 0.7) & ~browsing)
    wander = browsing & (score < 0.4)
    track = F.when(direct, "BUYING").when(wander, "BROWSING").when(score >= 0.4, "BUYING").otherwise("BROWSING")
    sure = F.when(explicit >= 2, 0.95).when(explicit > 0, 0.85).otherwise(0.75)
    return {"track": track, "confidence": F.when(direct, sure).when(wander, 0.85).when(score >= 0.4, 0.70).otherwise(0.60), "score": score}


def specificity(found: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in SPECIFICITY.items():
        if name in found:
            total = total + F.when(found[name].isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(total, 6)


def too_general(score: Column, pool: Column | None = None) -> Column:
    vague = score < SPECIFIC_ENOUGH
    return vague if pool is None else vague | F.coalesce(pool > POOL_TOO_LARGE, F.lit(False))


def router_phrases(found: dict[str, Column]) -> Column:
    """Text slots as extra phrases, trimmed, three characters or more, without repeats; numbers are dropped."""
    values = F.array(*[F.trim(v) for n, v in found.items() if n not in NUMERIC_SLOTS])
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.length(v) >= 3)))


def clarify_attribute(found: dict[str, Column]) -> Column:
    """What to ask for next: size, color, brand, category, or anything."""
    return F.when(found["size"].isNull(), "size").when(found["color"].isNull(), "color").when(found["store"].isNull(), "brand").when(found["main_category"].isNull(), "category").otherwise("other")


def clarify_text(found: dict[str, Column], price_mentioned: Column) -> Column:
    """The question that names up to three missing attributes."""
    missing = F.array_compact(
        F.array(
            F.when(found["size"].isNull(), "size"),
            F.when(found["color"].isNull(), "color"),
            F.when(found["store"].isNull(), "brand"),
            F.when(price_mentioned & found["price_max"].isNull(), "price range"),
        )
    )
    about = F.coalesce(found["main_category"], F.lit("items"))
    ask = F.concat(F.lit("I found many results for "), about, F.lit("! To help me narrow this down, could you specify your "), F.array_join(F.slice(missing, 1, 3), ", "), F.lit("?"))
    plain = F.concat(F.lit("Could you provide a bit more detail on what kind of "), about, F.lit(" you're looking for?"))
    return F.when(F.size(missing) > 0, ask).otherwise(plain)


def phrase_eligible(phrase: Column) -> Column:
    return (F.length(phrase) >= MIN_PHRASE_CHARS) & (F.size(tokens(phrase)) > 0)
