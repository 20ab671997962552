"""The session fold over a stream of turns, one state per session.

The same rules as ``operators.session.fold``, kept between micro-batches; a
test holds the two against each other.  State is a session's constraints and
words, bounded by what one customer can say.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import turns as T
from ..functions.text import tokens
from ..operators.session import MAX_HOLD_TURN, MIN_EVIDENCE

OUT = "session long, turn long, label string, is_override boolean, n_constraints long, n_revoked long, evidence_words long, hold boolean"
STATE = "json string"


def parsed(turns: DataFrame) -> DataFrame:
    """What each turn says under either label that may hold, computed in the JVM before the state is met."""
    message = F.col("message")
    words = lambda parts: F.transform(parts, lambda p: tokens(p))
    said = {}
    for name in ("plain", "any", "verbatim"):
        label = F.lit(None).cast("string") if name == "plain" else F.col(f"label_{name}")
        parts = T.preferred(T.segments(T.without_label(message, label)))
        said[name] = parts
    reset = F.coalesce("reset", F.lit(False)) if "reset" in turns.columns else F.lit(False)
    turns = turns.withColumns({"reset": reset, "message": F.coalesce("message", F.lit(""))})
    return turns.select(
        "session", "turn", "message", "reset", "label_any", "label_verbatim", T.is_override(message).alias("is_override"), T.is_empty_turn(message).alias("empty"),
        *[F.to_json(F.struct(p.alias("parts"), words(p).alias("words"))).alias(f"said_{n}") for n, p in said.items()],
    )


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold the new turns of one session, in order, into its state."""
    fresh = {"turn": 0, "label": None, "values": [], "revoked": 0, "words": []}
    now = json.loads(state.get[0]) if state.exists else copy.deepcopy(fresh)
    rows = []
    for r in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
        if r.reset:  # the session starts anew and says nothing
            now = copy.deepcopy(fresh)
            continue
        now["turn"] += 1
        if r.is_override:
            now["revoked"] = len(now["values"])
        if now["label"] is None:
            now["label"] = r.label_any
        elif r.is_override and r.label_verbatim is not None:
            now["label"] = r.label_verbatim
        if not r.empty:
            # The label that holds is one of this turn's, or an earlier one.
            by = {r.label_any: r.said_any, r.label_verbatim: r.said_verbatim} if now["label"] is not None else {}
            said = by.get(now["label"])
            said = json.loads(said if said is not None else r.said_plain)
            for value, words in zip(said["parts"], said["words"], strict=True):
                if value not in now["values"]:
                    now["values"].append(value)
                    now["words"] = sorted({*now["words"], *words})
        hold = now["turn"] <= MAX_HOLD_TURN and len(now["words"]) < MIN_EVIDENCE
        rows.append((key[0], now["turn"], now["label"], bool(r.is_override), len(now["values"]), now["revoked"], len(now["words"]), hold))
    state.update((json.dumps(now),))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def fold_stream(turns: DataFrame) -> DataFrame:
    """A streaming (or batch) DataFrame of turns to one row per turn with the state after it."""
    return parsed(turns).groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
