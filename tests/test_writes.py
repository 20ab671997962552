"""What stored tables cost in files."""

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from quarrylight.plans import simulate
from quarrylight.storage import stored


def test_stored_tables_have_no_marker(spark):
    table = stored(spark.range(100).repartition(3), "numbers")
    assert table.agg(F.sum("id")).head()[0] == 4950
    folder = Path(urlparse(table.inputFiles()[0]).path).parent
    assert list(folder.glob("part-*.parquet")) and not (folder / "_SUCCESS").exists()


def test_conversations_are_written_by_as_many_tasks_as_one_turn(spark):
    """Ten turns of all sessions, whole, without ten times the files."""
    parts = [(i, f"blue lamp {i}", "Maker", ["Lamps", "Maker"], [f"feature {i}"], {"size": "4"}, 9.5, f"blue lamp {i} Maker") for i in range(40)]
    products = spark.createDataFrame(parts, "doc_id long, title string, store string, path array<string>, features array<string>, details map<string,string>, price double, text string")
    kinds = ["buying", "browsing", "intent_override", "boundary"]
    samples = spark.createDataFrame([(f"s{i}", kinds[i % 4], i) for i in range(40)], "sample_id string, scenario_type string, target long").repartition(4)
    talk = simulate.conversations(samples, simulate.intent_cards(products), simulate.Config())
    assert talk.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert talk.count() == 400 and talk.select("session", "turn").distinct().count() == 400
