"""What must not grow with messages times labels, or with states times the catalog."""

from quarrylight.operators import category, fusion, pooled, rankers
from quarrylight.plans import search as P


def kept(monkeypatch, module) -> dict:
    """The tables that a module stores, by tag."""
    tables, real = {}, module.stored

    def stored(df, tag):
        tables[tag] = real(df, tag)
        return tables[tag]

    monkeypatch.setattr(module, "stored", stored)
    return tables


def test_overlap_is_found_once_for_messages_alike(spark, monkeypatch):
    tables = kept(monkeypatch, category)
    labels = spark.createDataFrame([(1, "blue desk lamps"), (2, "red desk lamp"), (3, "green chair")], "doc_id long, label string")
    said = [(i, f"some red lamp number {i}, for a desk") for i in range(40)] + [(50, "chairs"), (51, "a sofa"), (52, None)]
    got = {r.query_id: (r.label, r.score) for r in category.by_overlap(spark.createDataFrame(said, "query_id long, message string"), labels).collect()}
    assert got == {i: ("red desk lamp", 1.24) for i in range(40)} | {50: ("green chair", 0.58)}
    assert tables["label-sets"].count() == 2


def test_states_are_ranked_without_rows_for_the_catalog(spark, monkeypatch):
    """No join of postings or pools with states, several chunks of one pool, a short pool topped up, and a session without a label."""

    def refused(*args, **more):
        raise AssertionError("states times documents as rows")

    for module, name in ((rankers, "bm25"), (rankers, "category_affinity"), (rankers, "phrase_evidence"), (fusion, "places"), (fusion, "over_pool")):
        monkeypatch.setattr(module, name, refused)
    monkeypatch.setattr(pooled, "CHUNK", 2)
    rows = [(i, f"{['plain', 'fancy'][i % 2]} lamp no{i}", f"Maker{i % 3}", ["Lamps", f"Maker{i % 3}"], f"Lamps Maker{i % 3}") for i in range(30)]
    rows.append((99, "odd stool no99", "Solo", ["Stools", "Solo"], "Stools Solo"))
    idx = P.build_index(spark.createDataFrame(rows, "doc_id long, title string, store string, path array<string>, categories string"), P.Config())
    said = [(f"s{i}", 1, f"I'm looking for Lamps Maker{i % 3}. A key requirement is: fancy lamp no{i}.") for i in range(9)]
    said += [("short", 1, "I'm looking for Stools Solo. A key requirement is: odd stool no99."), ("bare", 1, "plain thing no12 tall bright heavy")]
    got = {r.session: [int(x.parent_asin) for x in r.recommendations] for r in P.respond(spark.createDataFrame(said, "session string, turn long, message string"), idx, P.Config(hold=False)).collect()}
    assert all(got[f"s{i}"][0] == i and len(got[f"s{i}"]) == 10 and {d % 3 for d in got[f"s{i}"]} == {i % 3} for i in range(9))
    assert got["short"][0] == 99 and len(got["short"]) == len(set(got["short"])) == 10
    assert got["bare"][0] == 12 and len(got["bare"]) == 10
