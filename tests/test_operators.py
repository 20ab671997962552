"""Operators on small rows worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.functions import turns as T
from quarrylight.operators import category, contract, dense, fusion, metrics, rankers, rerank, session
from quarrylight.plans import search as P
from quarrylight.plans import simulate
from quarrylight.sources import catalog, model_client
from quarrylight.streaming.session_stream import fold_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, X.normalise(F.lit("  A b\n\tC "))) == "a b c"
    assert one(spark, X.tokens(F.lit("The café X 42-mm of"))) == ["caf", "42", "mm"]
    assert one(spark, X.tokens(F.lit("the of a"), True)) == ["the", "of"]
    assert one(spark, X.flatten_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None)))) == "a 1 b None"
    assert one(spark, X.coarse_label(X.category_path(F.array(F.lit("Clothing, Shoes , "), F.lit("Boots"))))) == "Shoes Boots"
    assert one(spark, X.coarse_label(X.category_path(F.lit(None).cast("array<string>")))) == "clothing item"
    assert [one(spark, X.parse_price(F.lit(v))) for v in ("$1,299.00", "", "nan", "x", None)] == [1299.0, None, None, None, None]
    assert one(spark, X.clean_constraint(F.lit(" - a \n b;"), 180)) == "a b"
    assert [one(spark, X.classify_constraint(F.lit(v))) for v in ("under $5", "silk", "wide", "neck", "gym", "x")] == ["budget", "material", "size", "style", "use_case", "feature"]
    assert one(spark, X.pretty_label(F.lit("Shoes shoes Boots"))) == "shoes boots"
    assert one(spark, X.json_object(F.lit('so: {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}'


def test_turn_quirks(spark):
    said = F.lit("I'm looking for Lamps. A key requirement is: Bulb:warm.")
    parts = T.segments(T.without_label(said, F.lit("lamps")))
    # The label's place breaks the sentence end, so nothing is split.
    assert one(spark, T.preferred(parts)) == ["A key requirement is: Bulb:warm"]
    assert one(spark, T.lead_stripped(F.lit("A key requirement is: Q"))) == "is: Q"
    assert one(spark, T.candidates(F.array(F.lit("Salt and Pepper")))) == ["Salt and Pepper", "Salt", "Pepper"]
    assert one(spark, T.slot(F.lit("just $72"), "price_max")) is None
    assert one(spark, T.slot(F.lit("below $72"), "price_max")) == 72.0
    assert one(spark, T.slot(F.lit("size huge"), "size")) is None
    assert one(spark, T.slot(F.lit("size xxl"), "size")) == "size xxl"
    assert one(spark, T.is_empty_turn(F.lit("It's up to you.")))
    assert one(spark, T.without_label(F.lit("a \\E b"), F.lit("\\E"))) == "a   b"


def test_fusion(spark):
    rows = [(1, "lexical", 1, 2.0), (1, "lexical", 2, 1.0), (1, "lexical", 3, 0.0), (1, "phrase", 1, 0.0), (1, "phrase", 2, 0.0), (1, "phrase", 3, 0.0)]
    out = {r.doc_id: r.score for r in fusion.rrf(spark.createDataFrame(rows, "query_id long, ranker string, doc_id long, score double")).collect()}
    assert out == {1: round(1 / 61, 12), 2: round(1 / 62, 12), 3: round(1 / 63, 12)}
    one_, two = (spark.createDataFrame(x, "query_id long, doc_id long, score double") for x in ([(1, 5, 0.2)], [(1, 5, 9.0), (1, 6, 8.0), (1, 7, 7.0)]))
    got = [(r.doc_id, r.score, r.tier) for r in fusion.tiered(one_, two, 2).orderBy("position").collect()]
    assert got == [(5, 0.2, 0), (6, 4.0, 1)]
    assert fusion.rrf(spark.createDataFrame([], "query_id long, ranker string, doc_id long, score double")).count() == 0


def test_scope_modes(spark):
    docs = spark.createDataFrame([(i, ["Shoes", "Boots" if i < 12 else "Clogs"]) for i in range(15)] + [(20, ["Hats", "Warm Hats"])], "doc_id long, path array<string>")
    asked = spark.createDataFrame([(1, "shoes boots"), (2, "shoes clogs"), (3, "warm"), (4, "nothing here"), (5, None), (6, "shoes")], "query_id long, label string")
    pool = category.scope(asked, category.doc_labels(docs), category.doc_segments(docs))
    got = {r.query_id: (r["mode"], r.n_primary, r.n_fallback) for r in category.pool_sizes(pool, 16).collect()}
    assert got == {1: ("exact", 12, 15), 2: ("widened", 15, 16), 3: ("widened", 1, 16), 4: ("all", 16, 16), 5: ("all", 16, 16), 6: ("token", 15, 15)}


def test_places_across_partitions(spark):
    """One group holds almost all rows, so its places span partitions; null groups are groups."""
    rows = [(None if i % 50 == 0 else "big", (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, score long, doc_id long").repartition(7)
    got = {r.doc_id: (r["rank"], r.most) for r in fusion.places(df, ["g"], [F.desc("score"), F.asc("doc_id")], most=F.col("score")).collect()}
    for g in (None, "big"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [(i, own[0][1]) for i in range(1, len(own) + 1)]
    plan = metrics.stratified_split(df.select(F.col("g").alias("scenario_type"), F.col("doc_id").alias("sample_id")))._jdf.queryExecution().toString()
    assert "row_number" not in plan


def test_phrases_by_their_rarest_token(spark):
    """Postings name the documents; phrases without an inner token are still found inside words."""
    from quarrylight.operators import index

    texts = ["the bobcat foods are here", "cat food and more cat food", "a cat, food", "old lamp with brass foot", "Old  lamp\nwith brass foot, new", "lampwith"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "cat food"), (1, "Lamp with Brass foot"), (2, "lamp with unknown foot"), (2, "bobcat f")], "query_id long, phrase string")
    terms = rankers.query_terms(phrases.withColumnRenamed("phrase", "text"))
    corpus = index.corpus(docs, {"text": 1.0}, terms)
    rarity = rankers.phrase_rarity(phrases, corpus.idf)
    keys = {r.phrase: r.key for r in rankers.phrase_keys(rarity, corpus.idf).collect()}
    assert keys == {"cat food": None, "lamp with brass foot": "brass", "lamp with unknown foot": "unknown", "bobcat f": None}
    got = {(r.query_id, r.doc_id) for r in rankers.phrase_evidence(rarity, corpus, docs).collect()}
    assert got == {(1, 0), (1, 1), (1, 3), (1, 4), (2, 0)}
    pool = spark.createDataFrame([(1, 1), (1, 4), (2, 5)], "query_id long, doc_id long")
    assert {(r.query_id, r.doc_id) for r in rankers.phrase_evidence(rarity, corpus, docs, pool=pool).collect()} == {(1, 1), (1, 4)}


def test_labels_in_text(spark):
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(["red lamps", "lamps", "ox", "garden red lamps", "amps garden"])], "doc_id long, label string")
    said = spark.createDataFrame([(1, "Any garden red  lamps?"), (2, "boxes"), (3, "clamps garden"), (4, "nothing"), (5, None)], "query_id long, message string")
    got = {r.query_id: r.label for r in category.by_text(said, labels).collect()}
    assert got == {1: "garden red lamps", 2: "ox", 3: "amps garden"}


def test_dense_topk_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(rankers, "BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(60)] + [(60, None, 0), (61, [0.0] * 4, 1), (62, [1.0, 2.0], 2)]
    docs = spark.createDataFrame(vectors, "doc_id long, vector array<double>, label long").repartition(3)
    asked = docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    cos = lambda a, b: 0.0 if not a or not b or len(a) != len(b) or not any(a) or not any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for same in (None, "label"):
        got = sorted((r.query_id, r["rank"], r.doc_id) for r in fusion.top_k(rankers.dense_topk(asked, docs, 5, same), 5).collect())
        wanted = []
        for q, v, g in vectors:
            if q % 10 == 0:
                order = sorted((-round(cos(v, x), 6), d) for d, x, h in vectors if same is None or h == g)
                wanted += [(q, i, d) for i, (_, d) in enumerate(order[:5], 1)]
        assert got == sorted(wanted)


def test_cosine_abstains(spark):
    zero, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, rankers.cosine(zero, v)) == 0.0
    assert one(spark, rankers.cosine(v, v)) == pytest.approx(1.0)
    assert one(spark, rankers.cosine(F.lit(None).cast("array<double>"), v)) == 0.0


def turns(spark, rows):
    return spark.createDataFrame(rows, "session long, turn long, message string, label_any string, label_verbatim string")


CONVERSATION = [
    (1, 1, "I want a lantern", None, None), (1, 2, "tall brass storm lantern with blue glass, wick trimmed; iron hook", None, None),
    (1, 3, "Actually, ignore my earlier preference; round base", "oil lamps", None), (1, 4, "No opinion", None, None),
    (1, 5, "Actually, change to candles. Round base", "candles", "candles"), (2, 1, "looking for stools; wide seat", "stools", "stools"), (2, 2, "wide seat; oak legs", "chairs", "chairs"),
]


def test_session_fold(spark):
    got = {(r.session, r.turn): r for r in session.fold(turns(spark, CONVERSATION)).collect()}
    assert got[1, 1].hold and got[1, 1].evidence_words == 1
    assert not got[1, 2].hold and got[1, 2].n_revoked == 0
    assert got[1, 3].n_revoked == 3 and got[1, 3].label == "oil lamps"
    assert got[1, 4].n_constraints == got[1, 3].n_constraints
    assert got[1, 5].label == "candles"
    assert got[2, 2].label == "stools"  # without an override the category stays
    assert not got[1, 4].hold


def streamed(spark, parts, folder, name):
    """The folded turns of micro-batches, one for each part."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = fold_stream(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return plain(spark.table(name))


def plain(df):
    return sorted((tuple(r) for r in df.select("session", "turn", "label", "is_override", "n_constraints", "n_revoked", "evidence_words", "hold").collect()), key=str)


def test_reset_starts_anew(spark, tmp_path):
    rows = turns(spark, CONVERSATION[:5]).withColumn("reset", F.col("turn") == 3)
    got = {r.turn: r for r in session.fold(rows).collect()}
    assert sorted(got) == [1, 2] and got[1].n_constraints == 0 and got[2].label == "candles" and got[2].n_revoked == 0
    said = streamed(spark, [rows.filter("turn <= 2"), rows.filter("turn > 2")], tmp_path, "reset")
    before = plain(session.fold(rows.filter("turn <= 2").drop("reset")))
    assert said == sorted([*before, *plain(session.fold(rows))], key=str)


def test_stream_equals_batch(spark, tmp_path):
    rows = turns(spark, CONVERSATION)
    assert streamed(spark, [rows.filter("turn <= 2"), rows.filter("turn > 2")], tmp_path, "folded") == plain(session.fold(rows))


def test_contract(spark):
    rows = spark.createDataFrame([(1, ["A", "bad", "A", "B", "C"])], "query_id long, ids array<string>")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    assert [r.id for r in contract.normalise_recommendations(rows, known).orderBy("position").collect()] == ["A", "B", "C"]
    usage = {"prompt_tokens": F.lit(1), "completion_tokens": F.lit(-1)}
    problems = contract.violations(F.lit("m"), F.lit("mood"), F.array(F.lit("A"), F.lit("A")), usage)
    assert len(one(spark, problems)) == 3
    with pytest.raises(Exception, match="mood|allowed"):
        spark.range(1).select(contract.asserted(problems)).collect()
    fixed = contract.coerced(F.lit(None).cast("string"), F.lit("mood"), F.array(F.lit("A"), F.lit(""), F.lit("A")), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), usage)
    r = spark.range(1).select(*[c.alias(n) for n, c in fixed.items()]).first()
    assert (r.message, r.ask_attribute, [tuple(x) for x in r.recommendations], r.completion_tokens) == ("", None, [("A", 1.0)], 0)


def raw(**more):
    good = {"message": "m", "ask_attribute": None, "recommendations": [{"parent_asin": "A", "score": 1.0}], "usage": {"prompt_tokens": 1, "completion_tokens": 0}}
    return json.dumps(good | more)


@pytest.mark.parametrize(("text", "problems"), [
    (raw(), []), (raw(usage=None), []), (raw(message=42), ["message must be a string"]), (raw(ask_attribute="mood"), ["ask_attribute is not an allowed value"]),
    (json.dumps({"message": "m", "recommendations": []}), ["ask_attribute key is required"]), (raw(recommendations="nope"), ["recommendations must be a list"]),
    (raw(recommendations=[{"parent_asin": f"A{i}"} for i in range(101)]), ["recommendations exceed the cap"]), (raw(recommendations=[5]), ["recommendation is not an object"]),
    (raw(recommendations=[{"parent_asin": 5}]), ["recommendation has no id"]), (raw(recommendations=[{"parent_asin": "A"}] * 2), ["recommendation repeats an id"]),
    (raw(recommendations=[{"parent_asin": "A", "rank": 1}]), ["recommendation has extra keys"]), (raw(usage=7), ["usage must be an object"]),
    (raw(usage={"prompt_tokens": True}), ["usage.prompt_tokens must be a non-negative integer", "usage.completion_tokens must be a non-negative integer"]),
    ("[]", ["response is not an object"]), ("no", ["response is not an object"]), (None, ["response is not an object"]),
])
def test_json_contract(spark, text, problems):
    assert one(spark, contract.json_violations(F.lit(text).cast("string"))) == problems


def test_strict_contract_raises(spark):
    assert one(spark, contract.asserted(contract.json_violations(F.lit(raw()), strict=True))) is None
    with pytest.raises(Exception, match="extra keys"):
        one(spark, contract.asserted(contract.json_violations(F.lit(raw(more=1)), strict=True)))


def test_hung_calls_cost_only_themselves(spark):
    import time

    def call(prompt):
        if prompt.startswith("hung"):
            time.sleep(20)
        return [int(prompt.split()[1])]

    asked = [(i, f"hung {i}") for i in range(9)] + [(i, f"fast {i}") for i in range(9, 12)]
    rows = spark.createDataFrame(asked, "query_id long, prompt string").coalesce(1)
    began = time.time()
    got = {r.query_id: (r.status, [x.doc_id for x in r.ranked or []]) for r in rerank.answers(rows, call, deadline=0.5).collect()}
    assert time.time() - began < 10
    assert got == {i: ("timed_out", []) for i in range(9)} | {i: ("llm_ok", [i]) for i in range(9, 12)}
    counted = {r.status: r.n for r in rerank.counters(rerank.answers(rows, call, deadline=0.5)).collect()}
    assert counted == {"timed_out": 9, "llm_ok": 3}


def test_prompt_has_products_and_profile(spark):
    items = F.array(F.struct(F.lit(1).alias("position"), F.lit(10).alias("doc_id"), F.lit("B1").alias("parent_asin"), F.lit("stool").alias("title"), F.lit("Oak & Co").alias("store"), F.lit(9.5).alias("price")))
    context = F.array(*[F.lit(f"t{i}") for i in range(6)])
    profile = lambda tags, text: F.struct(tags.alias("preference_tags"), F.lit(text).alias("summary"))
    got = json.loads(one(spark, rerank.prompts(F.lit('{"store":"x"}'), context, items, profile(F.array(F.lit("warm")), "buys lamps"))))
    assert got["turns"] == ["t2", "t3", "t4", "t5"] and got["profile"] == {"tags": ["warm"], "summary": "buys lamps"}
    assert got["candidates"][0] == {"position": 1, "doc_id": 10, "parent_asin": "B1", "title": "stool", "store": "Oak & Co", "price": 9.5}
    none = json.loads(one(spark, rerank.prompts(F.lit("{}"), context, items, profile(F.array().cast("array<string>"), ""))))
    assert "profile" not in none


def shop(spark, n=30):
    rows = [(i, f"P{i}", f"{['plain', 'fancy'][i % 2]} lamp no{i}", f"Maker{i % 3}", ["Lamps", f"Maker{i % 3}"], f"Lamps Maker{i % 3}", 4.0 + i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, parent_asin string, title string, store string, path array<string>, categories string, price double")


def test_respond_turn_by_turn(spark):
    """A thin session is held for three turns and answered in the fourth; a rich one at once; nothing raises."""
    idx = P.build_index(shop(spark), P.Config())
    thin = [("thin", t, "I want a lamp", None) for t in (1, 2, 3, 4)]
    said = [*thin, ("rich", 1, "fancy lamp no7 from Maker1, tall, bright", None), ("odd", 1, None, None), ("odd", 2, "x" * 50_000, True), ("odd", 3, "fancy lamp no9 Maker0 bright", None)]
    frame = spark.createDataFrame(said, "session string, turn long, message string, reset boolean")
    got = {(r.session, r.turn): r for r in P.respond(frame, idx).collect()}
    assert set(got) == {("thin", 1), ("thin", 2), ("thin", 3), ("thin", 4), ("rich", 1), ("odd", 1)}  # odd was reset
    for t in (1, 2, 3):
        assert got["thin", t].held and got["thin", t].recommendations == [] and got["thin", t].ask_attribute == "other" and "size, color, brand" in got["thin", t].message
    assert len(got["thin", 4].recommendations) == 10 and not got["thin", 4].held and got["thin", 4].message == P.FOUND_MESSAGE
    assert got["rich", 1].recommendations[0].parent_asin == "P7" and got["rich", 1].status == "off"
    ungated = {(r.session, r.turn): r for r in P.respond(frame, idx, P.Config(hold=False)).collect()}
    assert all(len(r.recommendations) == 10 for r in ungated.values())
    asks = {r.turn: r for r in P.respond(frame, idx, P.Config(hold=False, clarify=True)).collect() if r.session == "thin"}
    assert asks[1].ask_attribute == "size" and len(asks[1].recommendations) == 10 and "could you specify" in asks[1].message
    assert P.respond(frame.filter("false"), idx).count() == 0


def test_respond_with_models(spark):
    idx = P.build_index(shop(spark), P.Config())
    frame = spark.createDataFrame([("rich", 1, "fancy lamp no7 from Maker1, tall, bright")], "session string, turn long, message string")
    plain = [x.parent_asin for x in P.respond(frame, idx).first().recommendations]
    run = lambda call, **more: P.respond(frame, idx, call=call, use_model=True, **more).first()
    assert [x.parent_asin for x in run(rerank.stub("reverse")).recommendations] == plain[::-1]
    assert sorted(x.parent_asin for x in run(rerank.stub("shuffle")).recommendations) == sorted(plain)
    for call, status in ((None, "no_key"), (rerank.stub("broken"), "failed")):
        r = run(call)
        assert ([x.parent_asin for x in r.recommendations], r.status, r.usage.prompt_tokens) == (plain, status, 0)
    late = run(rerank.stub("slow", 20), deadline=0.5)
    assert ([x.parent_asin for x in late.recommendations], late.status) == (plain, "timed_out")
    last = int(plain[-1][1:])
    invents = run(lambda p: {"ranked": [{"doc_id": 999, "score": 9.0}, {"doc_id": last, "score": 5.0}], "prompt_tokens": 100, "completion_tokens": 25})
    assert [x.parent_asin for x in invents.recommendations] == [plain[-1], *plain[:-1]]
    assert invents.recommendations[0].score == 5.0 and invents.usage.prompt_tokens == 100


def test_resilient_serves_the_baseline(spark):
    import time

    idx = P.build_index(shop(spark), P.Config())
    frame = spark.createDataFrame([("a", 1, "fancy lamp no7 from Maker1, tall, bright"), ("b", 1, "lamp")], "session string, turn long, message string")
    base = P.respond(frame, idx)
    wanted = {r.session: r for r in base.collect()}

    def fails(prompt):
        raise ConnectionError("no network")

    cases = [
        (fails, "enhance: ConnectionError: no network"), (lambda p: {"message": 42, "ask_attribute": "not_one", "recommendations": "nope"}, "enhance contract: message must be a string"),
        (lambda p: time.sleep(20), "enhance: timed out"), (lambda p: [1], "enhance contract: response is not an object"), (None, None),
    ]
    for plug_in, failure in cases:
        got = {r.session: r for r in P.resilient(base, plug_in, deadline=1.0).collect()}
        assert {s: (r.message, r.recommendations) for s, r in got.items()} == {s: (r.message, r.recommendations) for s, r in wanted.items()}
        assert {r.failure for r in got.values()} == {failure}
    better = P.resilient(base, lambda p: json.loads(p)["response"] | {"message": "Better."}).collect()
    assert {r.message for r in better} == {"Better."} and {r.failure for r in better} == {None}


def test_rerank(spark):
    given = spark.createDataFrame([(1, 10, 1, 2.0), (1, 11, 2, 1.0)], "query_id long, doc_id long, position int, score double")
    prompt = json.dumps({"candidates": [{"doc_id": 10}, {"doc_id": 11}]})
    asked = spark.createDataFrame([(1, prompt)], "query_id long, prompt string")
    for call, status, order in ((None, "no_key", [10, 11]), (rerank.stub("reverse"), "llm_ok", [11, 10]), (rerank.stub("broken"), "failed", [10, 11])):
        got = rerank.answers(asked, call)
        assert got.first().status == status
        assert [r.doc_id for r in rerank.rerank(given, got).orderBy("position").collect()] == order
    said = spark.createDataFrame([(1, 99, 1), (1, 11, 2)], "query_id long, doc_id long, position int")
    assert [(r.doc_id, r.score) for r in contract.reconcile(given, said).orderBy("position").collect()] == [(11, 1.0), (10, 2.0)]


def test_metrics(spark):
    rows = spark.createDataFrame([("buying", True, 0.5, 2), ("buying", False, 0.0, None)], "scenario_type string, hit boolean, reciprocal_rank double, first_hit_turn int")
    m = metrics.composite(metrics.summary(rows)).first()
    assert (m["count"], m.hit_rate, m.mrr, m.mttc, m.efficiency) == (2, 0.5, 0.25, 6.5, 0.45)
    assert m.technical_score == pytest.approx(0.5 * 0.5 + 0.3 * 0.25 + 0.2 * 0.45)
    empty = metrics.composite(metrics.summary(rows.filter("false"))).first()
    assert (empty["count"], empty.hit_rate, empty.mttc) == (0, 0.0, None)


def product(i, title, **more):
    return json.dumps({"parent_asin": f"B{i}", "title": title, "features": ["oak"], "details": {"room": "kitchen"}, "categories": ["Clothing, Seats", "Stools"], "store": "Oak & Co", "price": 21.0 + i} | more)


def test_catalog(spark, tmp_path):
    (tmp_path / "catalog.jsonl").write_text("\n".join([product(0, "Low  stool"), "", product(1, "Tall stool", price="$1,089.00"), product(0, "Red stool", price=None)]) + "\n")
    path = str(tmp_path / "catalog.jsonl")
    rows = catalog.read_products(spark, path).orderBy("doc_id").collect()
    assert [(r.doc_id, r.parent_asin, r.title, r.price) for r in rows] == [(0, "B0", "low stool", 21.0), (1, "B1", "tall stool", 1089.0), (2, "B0", "red stool", None)]
    assert rows[0].details == "room kitchen" and rows[0].path == ["Seats", "Stools"]
    assert {(r.parent_asin, r.doc_id) for r in catalog.last_of_each_id(catalog.read_products(spark, path)).collect()} == {("B0", 2), ("B1", 1)}
    assert catalog.resolve("no/such/file") == "no/such/file"
    assert catalog.resolve("catalog.jsonl", str(tmp_path)) == path
    table = catalog.index_tables(spark, "k", lambda: spark.range(3), str(tmp_path / "index"))
    assert catalog.index_tables(spark, "k", lambda: 1 / 0, str(tmp_path / "index")) is table and table.count() == 3
    raw = catalog.read_raw_products(spark, path)
    ids, categories, products = catalog.evaluator_index(raw)
    assert {r.parent_asin for r in ids.collect()} == {"B0", "B1"}
    assert {r.parent_asin: r.categories for r in categories.collect()}["B1"] == ["Clothing, Seats", "Stools"]
    assert {r.parent_asin: r.product.title for r in products.collect()} == {"B0": "Red stool", "B1": "Tall stool"}
    text = catalog.customer_products(raw).filter("doc_id = 0").first()
    assert text.text == "Low  stool oak room kitchen Clothing, Seats Stools Oak & Co" and text.features == ["oak"] and text.price == "21.0"


def test_catalog_of_several_files(spark, tmp_path):
    """Numbers follow file names and lines, whatever the sizes of the files."""
    titles = []
    for name, n in (("a.jsonl", 40), ("b.jsonl", 3000), ("c.jsonl", 5)):
        own = [f"{name} {i}" for i in range(n)]
        (tmp_path / name).write_text("\n".join(product(len(titles) + i, t) for i, t in enumerate(own)) + "\n")
        titles += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = catalog.read_raw_products(spark, str(tmp_path)).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.doc_id, r.title) for r in rows] == list(enumerate(titles))


def test_results_and_embeddings(spark, tmp_path):
    one_row = spark.createDataFrame([("r", 0.5)], "label string, hit_rate double")
    catalog.write_summary(one_row, f"{tmp_path}/s.json")
    assert (tmp_path / "s.json").read_text() == '{\n  "label": "r",\n  "hit_rate": 0.5\n}\n'
    assert catalog.read_results(spark, f"{tmp_path}/s.json").first().hit_rate == 0.5
    with pytest.raises(ValueError, match="one row"):
        catalog.write_summary(one_row.union(one_row), f"{tmp_path}/t.json")
    catalog.write_results(one_row.union(one_row), f"{tmp_path}/r.jsonl")
    assert catalog.read_results(spark, f"{tmp_path}/r.jsonl").count() == 2
    docs = spark.createDataFrame([(1, "a" * 600), (2, None)], "doc_id long, text string")
    first = catalog.embeddings(docs, f"{tmp_path}/v", "m", lambda t: [[float(len(x)), 0.0] for x in t])
    assert {r.doc_id: r.vector for r in first.collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    again = catalog.embeddings(docs, f"{tmp_path}/v", "m", lambda t: 1 / 0)  # read, not encoded
    assert again.count() == 2 and catalog.embedding_path("f/", "m", 2) != catalog.embedding_path("f/", "n", 2)


def test_command_line(spark, tmp_path, capsys):
    from quarrylight.plans import cli

    goods = [product(i, f"{['low', 'tall'][i % 2]} stool no{i}", categories=["Seats", ["Stools", "Benches"][i % 2]], features=[f"oak grade {i}"]) for i in range(24)]
    (tmp_path / "catalog.jsonl").write_text("\n".join(goods) + "\n")
    samples = [json.dumps({"sample_id": f"s{i}", "scenario_type": k, "user_profile": {}, "ground_truth": {"parent_asin": f"B{i}"}}) for i, k in enumerate(["buying", "browsing", "boundary"])]
    (tmp_path / "set.jsonl").write_text("\n".join(samples) + "\n")
    (tmp_path / "base.json").write_text(json.dumps({"hit_rate": 0.5, "mrr": 0.25, "mttc": 9.0, "efficiency": 0.2, "technical_score": 0.3}))
    at = ["--catalog", f"{tmp_path}/catalog.jsonl", "--dataset", f"{tmp_path}/set.jsonl"]
    assert cli.main(["evaluate", *at, "--output", f"{tmp_path}/out.json", "--baseline", f"{tmp_path}/base.json", "--ask-attribute", "feature"], spark) == 0
    got = json.loads((tmp_path / "out.json").read_text())
    assert got["count"] == 3 and got["delta_hit_rate"] == pytest.approx(got["hit_rate"] - 0.5)
    assert cli.main(["perturb", *at, "--styles", "terse", "--output", f"{tmp_path}/styles"], spark) == 0
    assert spark.read.json(f"{tmp_path}/styles").first().style == "terse"
    assert cli.main(["integrated", *at, "--fake-llm", "reverse", "--output", f"{tmp_path}/runs"], spark) == 0
    assert {r.config for r in spark.read.json(f"{tmp_path}/runs").collect()} == {"without", "with"}
    assert "technical_score" in capsys.readouterr().out


def test_seeds_and_paraphrase(spark):
    import zlib

    from quarrylight.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    for r in QUERIES["hash_seeds"](spark, sf).collect():
        assert r.seed == zlib.crc32(f"sample_{r.conv_id}_{r.turn}".encode()) & 0xFFFF
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    for r in QUERIES["paraphrase"](spark, sf).collect():
        text = texts[r.conv_id, r.turn]
        assert r.text == (None if text is None else simulate.reworded(text, zlib.crc32(f"sample_{r.conv_id}".encode()) & 0xFFFF, 0.25))


def test_simulation(spark):
    names = ["red ring", "blue bolt", "green gear", "old widget"]
    rows = [(i, names[i % 4], f"Brand{i % 3}", ["Tools", f"Brand{i % 3}"], f"Tools Brand{i % 3}", 10.0 + i, [f"grade {i} steel"]) for i in range(24)]
    products = spark.createDataFrame(rows, "doc_id long, title string, store string, path array<string>, categories string, price double, features array<string>")
    products = products.withColumns({"details": F.create_map(F.lit("size"), F.col("doc_id").cast("string")), "text": F.concat_ws(" ", "title", "categories")})
    cards = simulate.intent_cards(products)
    card = cards.filter("doc_id = 0").first()
    assert card.hard == ["grade 0 steel", "color: red"] and card.soft == ["size: 0", "budget around $10.0"]
    samples = spark.createDataFrame([("s1", "buying", 0), ("s2", "intent_override", 5)], "sample_id string, scenario_type string, target long")
    hidden = {r.sample_id: r for r in simulate.hidden(samples, cards).collect()}
    assert hidden["s2"].override_turn in (3, 4) and hidden["s1"].override_turn is None
    out = {r.sample_id: r for r in simulate.evaluate(samples, products, cards, P.Config(fields={"title": 3.0, "categories": 2.0, "store": 1.5})).collect()}
    assert set(out) == {"s1", "s2"} and all(r.hit == (r.first_hit_turn is not None) for r in out.values())
    assert simulate.reworded("a durable gear", 1, 0.0) == "a built to last gear"


def test_dense_space(spark):
    import numpy as np

    texts = ["red wool scarf", "red wool hat", "blue steel bolt", "blue steel gear", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert one(spark, dense.grams(F.lit("red wool hat"))) == ["red", "wool", "hat", "red wool", "wool hat"]
    assert one(spark, dense.grams(F.lit("red"))) == ["red"] and one(spark, dense.grams(F.lit(""))) == []
    v = {r.doc_id: r.vector for r in dense.project(docs, dense.fit(docs, dims=2)).collect()}
    cos = lambda i, j: sum(a * b for a, b in zip(v[i], v[j], strict=True))
    assert cos(0, 1) > 0.99 and cos(2, 3) > 0.99 and abs(cos(0, 2)) < 0.01 and v[4] == [0.0, 0.0]
    got = dense.encode(docs, lambda t: [[len(x), 0.0] for x in t]).first()
    assert got.vector == [1.0, 0.0]
    # Cosines in the space are those of an exact decomposition of the same matrix.
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    many = spark.createDataFrame([(i, " ".join(rng.choice(words, 12, p=np.arange(30, 0, -1) / 465))) for i in range(80)], "doc_id long, text string")
    space = dense.fit(many, dims=8, rounds=12)
    rows = {r.doc_id: r["items"] for r in dense.rows_of(dense.weighted(many, space.terms)).collect()}
    a = np.zeros((80, len(space.axes)))
    for i, items in rows.items():
        for x in items:
            a[i, x["at"]] = x["w"]
    exact = a @ np.linalg.svd(a, full_matrices=False)[2][:8].T
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    found = np.array([r.vector for r in dense.project(many, space).orderBy("doc_id").collect()])
    assert np.abs(found @ found.T - exact @ exact.T).max() < 0.02
    empty = dense.fit(docs.filter("false"))
    assert dense.project(docs, empty).count() == 5


def test_model_client(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# no\nA_KEY='x'\nB_KEY=y\n")
    monkeypatch.setenv("B_KEY", "kept")
    monkeypatch.setenv("A_KEY", "")
    monkeypatch.delenv("A_KEY")
    assert model_client.load_settings(str(tmp_path / ".env")) == {"A_KEY": "x", "B_KEY": "y"}
    import os

    assert (os.environ["A_KEY"], os.environ["B_KEY"]) == ("x", "kept")
    assert model_client.used('{"usage": {"input_tokens": 7, "output_tokens": 2}}') == {"prompt_tokens": 7, "completion_tokens": 2}
    assert model_client.used("text") == {"prompt_tokens": 0, "completion_tokens": 0}
    assert model_client.ranked_ids('sure: {"ranked": [3, "1"]} !') == [3, 1]
    assert model_client.preflight("http://127.0.0.1:9/", None, "m") == "no_key"
    assert model_client.preflight("http://127.0.0.1:9/", "k", "m").startswith("failed")
    with pytest.raises(ValueError, match="JSON"):
        model_client.ranked_ids("I am not JSON")
