"""The response contract: normalise, validate, repair, build, enrich, reconcile.

A response is a struct of message, ask_attribute, recommendations (array of
parent_asin and score) and usage (prompt_tokens, completion_tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attributes that may be asked for, and the cap on recommendations.
ATTRIBUTES = ["category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other"]
CAP = 100
TOP_K = 10


def normalise_recommendations(rows: DataFrame, catalog: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, id, position): trimmed ids that the catalog knows, each at its first place, the first k.

    ``rows`` has query_id and ids (array of strings); ``catalog`` has id.
    """
    each = rows.select("query_id", F.posexplode("ids").alias("pos", "raw")).select("query_id", "pos", F.trim("raw").alias("id")).filter("id <> ''")
    first = each.groupBy("query_id", "id").agg(F.min("pos").alias("pos")).join(catalog.select("id").distinct(), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return first.select("query_id", "id", place.cast("long").alias("position")).filter(F.col("position") <= k)


def violations(message: Column, attribute: Column, ids: Column, usage: dict[str, Column], top_k: int = TOP_K) -> Column:
    """What is wrong with a response, as an array of texts; empty if it is valid."""
    shown = F.slice(ids, 1, top_k)
    missing = F.size(F.filter(shown, lambda x: x.isNull() | (x == "")))
    named = F.filter(shown, lambda x: x.isNotNull() & (x != ""))
    checks = [
        F.when(message.isNull(), "message must be a string"),
        F.when(attribute.isNotNull() & ~attribute.isin(ATTRIBUTES), "ask_attribute is not an allowed value"),
        F.when(ids.isNull(), "recommendations must be a list"),
        F.when(F.size(ids) > CAP, "recommendations exceed the cap"),
        F.when(missing > 0, "recommendation has no id"),
        F.when(F.size(named) > F.size(F.array_distinct(named)), "recommendation repeats an id"),
        *[F.when(v.isNull() | (v < 0), f"usage.{name} must be a non-negative integer") for name, v in usage.items()],
    ]
    return F.array_compact(F.array(*checks))


def json_violations(raw: Column, top_k: int = TOP_K, strict: bool = False) -> Column:
    """What is wrong with a response as JSON text, of any types, as an array of texts; empty if it is valid.

    ``strict`` also refuses further keys of the response itself.
    """
    v = F.try_parse_json(raw)
    part = lambda path: F.try_variant_get(v, path, "variant")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("MISSING"))
    text = lambda path: F.try_variant_get(v, path, "string")
    items = F.coalesce(F.try_variant_get(v, "$.recommendations", "array<variant>"), F.array().cast("array<variant>"))
    shown = F.slice(items, 1, top_k)
    objects = F.filter(shown, lambda x: kind(x).startswith("OBJECT<"))
    own_id = lambda x: F.when(kind(F.try_variant_get(x, "$.parent_asin", "variant")) == "STRING", F.try_variant_get(x, "$.parent_asin", "string"))
    ids = F.filter(F.transform(objects, own_id), lambda x: x.isNotNull() & (x != ""))
    more = lambda x, allowed: F.size(F.array_except(F.json_object_keys(x), F.array(*[F.lit(k) for k in allowed]))) > 0
    ask, usage = kind(part("$.ask_attribute")), kind(part("$.usage"))
    has_usage = ~usage.isin("MISSING", "VOID")
    is_list = kind(part("$.recommendations")).startswith("ARRAY<")
    checks = [
        F.when(kind(part("$.message")) != "STRING", "message must be a string"),
        F.when(ask == "MISSING", "ask_attribute key is required").when((ask != "VOID") & ~((ask == "STRING") & text("$.ask_attribute").isin(ATTRIBUTES)), "ask_attribute is not an allowed value"),
        F.when(~is_list, "recommendations must be a list"),
        F.when(F.size(items) > CAP, "recommendations exceed the cap"),
        F.when(F.size(objects) < F.size(shown), "recommendation is not an object"),
        F.when(F.size(ids) < F.size(objects), "recommendation has no id"),
        F.when(F.size(ids) > F.size(F.array_distinct(ids)), "recommendation repeats an id"),
        F.when(F.exists(objects, lambda x: more(F.to_json(x), ["parent_asin", "score"])), "recommendation has extra keys"),
        F.when(has_usage & ~usage.startswith("OBJECT<"), "usage must be an object"),
        *[
            F.when(has_usage & usage.startswith("OBJECT<") & ~((kind(part(f"$.usage.{n}")) == "BIGINT") & (F.try_variant_get(v, f"$.usage.{n}", "bigint") >= 0)), f"usage.{n} must be a non-negative integer")
            for n in ("prompt_tokens", "completion_tokens")
        ],
        *([F.when(more(raw, ["message", "ask_attribute", "recommendations", "usage"]), "response has extra keys")] if strict else []),
    ]
    return F.when(kind(v).startswith("OBJECT<"), F.array_compact(F.array(*checks))).otherwise(F.array(F.lit("response is not an object")))


def asserted(problems: Column) -> Column:
    """Raises on the first row with a violation; null otherwise."""
    return F.when(F.size(problems) > 0, F.raise_error(F.array_join(problems, "; ")))


def coerced(message: Column, attribute: Column, ids: Column, scores: Column, usage: dict[str, Column]) -> dict[str, Column]:
    """The same response with everything repaired that can be."""
    pairs = F.filter(F.arrays_zip(ids.alias("id"), scores.alias("score")), lambda x: x["id"].isNotNull() & (x["id"] != ""))
    names = F.transform(pairs, lambda x: x["id"])
    firsts = F.filter(pairs, lambda x, i: F.array_position(names, x["id"]) == i + 1)
    good = F.lit(True)
    for v in usage.values():
        good = good & v.isNotNull() & (v >= 0)
    return {
        "message": F.coalesce(message, F.lit("")),
        "ask_attribute": F.when(attribute.isin(ATTRIBUTES), attribute),
        "recommendations": F.coalesce(F.slice(firsts, 1, CAP), F.array().cast("array<struct<id:string,score:double>>")),
        **{n: F.when(good, v).otherwise(0) for n, v in usage.items()},
    }


def recommendations(ranked: DataFrame, by: list[str], top_k: int = TOP_K) -> DataFrame:
    """(by, recommendations) of ranked (by, id, score, rank): deduplicated, cut, in order."""
    rows = ranked.filter("id is not null and id <> ''").groupBy(*by, "id").agg(F.min(F.struct("rank", "score")).alias("best"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("best.rank"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= min(top_k, CAP))
    items = F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "best.score"))), lambda x: F.struct(x["id"].alias("parent_asin"), x["score"].alias("score")))
    return rows.groupBy(*by).agg(items.alias("recommendations"))


def build(ranked: DataFrame, message: Column, ask: Column, top_k: int = TOP_K) -> DataFrame:
    """One response per query of ranked (query_id, id, score, rank)."""
    rows = recommendations(ranked, ["query_id"], top_k)
    checked = F.when(ask.isNull() | ask.isin(ATTRIBUTES), ask).otherwise(F.raise_error(F.lit("ask_attribute is not an allowed value")).cast("string"))
    return rows.select("query_id", message.alias("message"), checked.alias("ask_attribute"), "recommendations", F.struct(F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens")).alias("usage"))


def enrich(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metadata for ranked rows by doc_id; a row that the catalog does not know keeps its id and score."""
    return ranked.join(catalog, "doc_id", "left")


def reconcile(given: DataFrame, answer: DataFrame) -> DataFrame:
    """Ids that a reranker returned, without invented ones and repeats, then those it left out in their old order.

    ``given``: query_id, doc_id, position, score; ``answer``: query_id, doc_id,
    position and perhaps score, which then takes the place of the old one.
    """
    said = answer if "score" in answer.columns else answer.withColumn("score", F.lit(None).cast("double"))
    named = said.groupBy("query_id", "doc_id").agg(F.min("position").alias("at"), F.min_by("score", "position").alias("new"))
    rows = given.join(named, ["query_id", "doc_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("at").isNull(), F.coalesce("at", "position"))
    return rows.select("query_id", "doc_id", F.coalesce("new", "score").alias("score"), F.row_number().over(order).alias("position"))
