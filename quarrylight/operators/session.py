"""Conversation state, folded over ordered turns with window functions.

``turns`` has session, turn (rising within a session), message, and label_any /
label_verbatim (nullable labels found in the message).  Each window is keyed by
the session, whose turns are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import turns as T
from ..functions.text import tokens

MIN_EVIDENCE, MAX_HOLD_TURN = 4, 3


def so_far() -> Window:
    return Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)


def restarted(turns: DataFrame) -> DataFrame:
    """Turns after the last reset of their session.

    A row whose ``reset`` is true starts its session anew: nothing said before
    it counts, and it says nothing itself.  Tables without the column have no
    resets.
    """
    if "reset" not in turns.columns:
        return turns
    last = F.max(F.when(F.col("reset"), F.col("turn"))).over(Window.partitionBy("session"))
    rows = turns.withColumn("last_reset", last)
    return rows.filter("last_reset is null or turn > last_reset").drop("last_reset", "reset")


def numbered(turns: DataFrame) -> DataFrame:
    """turn replaced by 1, 2, ... in its order, since the session's last reset; a null message is empty."""
    w = Window.partitionBy("session").orderBy("turn")
    return restarted(turns).withColumns({"turn": F.row_number().over(w), "message": F.coalesce("message", F.lit(""))})


def sticky_label(turns: DataFrame) -> DataFrame:
    """label: the first one found; after it only a label named verbatim in an override turn replaces it."""
    w = so_far()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    had = F.max(F.col("label_any").isNotNull().cast("int")).over(before)
    first = F.coalesce(had, F.lit(0)) == 0
    event = F.when(first, F.col("label_any")).when(T.is_override(F.col("message")), F.col("label_verbatim"))
    return turns.withColumn("event", event).withColumn("label", F.last("event", ignorenulls=True).over(w)).drop("event")


def constraints(turns: DataFrame) -> DataFrame:
    """(session, place, value, turn): constraints in the order of disclosure, each at its first."""
    said = turns.filter(~T.is_empty_turn(F.col("message")))
    parts = T.preferred(T.segments(T.without_label(F.col("message"), F.col("label"))))
    rows = said.select("session", "turn", F.posexplode(parts).alias("pos", "value"))
    first = F.row_number().over(Window.partitionBy("session", "value").orderBy("turn", "pos"))
    rows = rows.withColumn("nth", first).filter("nth = 1")
    place = F.row_number().over(Window.partitionBy("session").orderBy("turn", "pos")) - 1
    return rows.select("session", place.alias("place"), "value", "turn")


def phrases(turns: DataFrame, router: bool = False) -> DataFrame:
    """(session, turn, phrase): every new candidate form; with ``router`` the turn's text slots before them."""
    forms = T.candidates(T.segments(T.without_label(F.col("message"), F.col("label"))))
    empty = F.array().cast("array<string>")
    both = F.when(T.is_empty_turn(F.col("message")), empty).otherwise(forms)
    if router:
        # Only brand and category reach the ranker; the tracker takes size and colour for itself.
        both = F.concat(T.router_phrases({n: c for n, c in T.slots(F.col("message")).items() if n not in ("size", "color")}), both)
    rows = turns.select("session", "turn", F.posexplode(both).alias("pos", "phrase"))
    first = F.row_number().over(Window.partitionBy("session", "phrase").orderBy("turn", "pos"))
    return rows.withColumn("nth", first).filter("nth = 1").select("session", "turn", "phrase")


def fold(turns: DataFrame) -> DataFrame:
    """One row per turn: its number, label, whether it overrides, constraints so far, those revoked, evidence words, hold.

    Constraints said before the last override so far are revoked; a restated
    one stays where it was first said.
    """
    turns = sticky_label(numbered(turns))
    return folded(turns, constraints(turns))


def folded(turns: DataFrame, known: DataFrame) -> DataFrame:
    """The fold of numbered turns with their labels and their constraints."""
    new = known.groupBy("session", "turn").agg(F.count("*").alias("new"))
    words = known.select("session", "turn", F.explode(tokens(F.col("value"))).alias("word")).groupBy("session", "word").agg(F.min("turn").alias("turn"))
    words = words.groupBy("session", "turn").agg(F.count("*").alias("new_words"))
    rows = turns.join(new, ["session", "turn"], "left").join(words, ["session", "turn"], "left").fillna(0, ["new", "new_words"])
    w = so_far()
    rows = rows.withColumn("n_constraints", F.sum("new").over(w)).withColumn("is_override", T.is_override(F.col("message")))
    before = F.col("n_constraints") - F.col("new")
    rows = rows.withColumn("n_revoked", F.coalesce(F.max(F.when(F.col("is_override"), before)).over(w), F.lit(0)))
    rows = rows.withColumn("evidence_words", F.sum("new_words").over(w))
    return rows.withColumn("hold", hold(F.col("turn"), F.col("evidence_words"))).select(
        "session", "turn", "label", "is_override", "n_constraints", "n_revoked", "evidence_words", "hold"
    )


def hold(turn: Column, evidence: Column, min_words: int = MIN_EVIDENCE, max_turn: int = MAX_HOLD_TURN) -> Column:
    """Too little evidence in an early turn: ask instead of recommending."""
    return (turn <= max_turn) & (evidence < min_words)


def decay(turns: DataFrame, slot_decay: float = 0.8, override_penalty: float = 0.5) -> DataFrame:
    """(session, place, value, age, revoked, weight) of each constraint at the session's last turn."""
    from .rankers import decayed

    turns = sticky_label(numbered(turns))
    known = constraints(turns)
    last = turns.groupBy("session").agg(F.max("turn").alias("last"), F.max(F.when(T.is_override(F.col("message")), F.col("turn"))).alias("over"))
    rows = known.join(last, "session").withColumn("age", F.col("last") - F.col("turn"))
    revoked = F.coalesce(F.col("turn") < F.col("over"), F.lit(False))
    return rows.select("session", "place", "value", "age", revoked.alias("revoked"), F.round(decayed(F.lit(1.0), F.col("age"), revoked, slot_decay, override_penalty), 6).alias("weight"))


def slot_state(turns: DataFrame, number: bool = True) -> DataFrame:
    """One row per turn: the last value so far of every slot, and the categories so far in order, each once."""
    w = so_far()
    rows = numbered(turns) if number else turns
    found = T.slots(F.col("message"))
    rows = rows.withColumns({f"now_{n}": c for n, c in found.items()})
    state = {n: F.last(f"now_{n}", ignorenulls=True).over(w) for n in found}
    categories = F.array_distinct(F.collect_list("now_main_category").over(w))
    mentioned = F.max(F.contains(F.lower("message"), F.lit("price")).cast("int")).over(w) == 1
    return rows.withColumns({**state, "categories": categories, "price_mentioned": mentioned}).select("session", "turn", *found, "categories", "price_mentioned")


def last_turns(turns: DataFrame, n: int = 4) -> DataFrame:
    """(session, turn, context): up to the last n messages, oldest first, as a prompt shows them."""
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(1 - n, 0)
    return turns.select("session", "turn", F.collect_list("message").over(w).alias("context"))


def distilled(state: DataFrame) -> DataFrame:
    """(session, turn, json): the filled slots only, as JSON; size and colour are details."""
    details = F.when(F.col("size").isNotNull() | F.col("color").isNotNull(), F.struct("size", "color"))
    filled = F.when(F.size("categories") > 0, F.col("categories"))
    slots_ = F.struct(F.col("main_category").alias("category"), filled.alias("categories"), "store", "price_max", "price_min", "min_rating", details.alias("details"))
    return state.select("session", "turn", F.to_json(slots_).alias("json"))
