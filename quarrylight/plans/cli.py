"""Command line: ``python -m quarrylight.plans.cli COMMAND ...``.

query       run one registered query over a folder of tables
evaluate    play the sessions of a data set against a catalog; a summary, and its difference from an earlier one
perturb     the same for customers who speak in other styles
integrated  the same with and without a model, or a stand-in for one
preflight   whether a model answers
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, rerank
from ..operators.index import FIELD_WEIGHTS
from ..sources import catalog, model_client
from ..storage import stored
from . import simulate
from .queries import queries
from .search import Config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("query")
    one.add_argument("query", choices=sorted(queries()))
    one.add_argument("sf_dir")
    one.add_argument("--out")
    for name in ("evaluate", "perturb", "integrated"):
        run = commands.add_parser(name)
        run.add_argument("--catalog", required=True)
        run.add_argument("--dataset", required=True)
        run.add_argument("--output")
        run.add_argument("--ask-attribute", default="other")
        run.add_argument("--phrase-weight", type=float, default=1.6)
        run.add_argument("--weights", default="", help="such as phrase=2.0,category=0.2")
        for flag in ("drop-overridden", "no-category", "no-fusion", "no-hold", "router", "clarify"):
            run.add_argument(f"--{flag}", action="store_true")
        if name == "evaluate":
            run.add_argument("--baseline")
        if name == "perturb":
            run.add_argument("--styles", default="clean,natural,terse,paraphrase,hostile")
        if name == "integrated":
            run.add_argument("--fake-llm", choices=["identity", "reverse", "shuffle"])
            run.add_argument("--url")
            run.add_argument("--model", default="")
    check = commands.add_parser("preflight")
    check.add_argument("--url", required=True)
    check.add_argument("--model", default="")
    return out


def config_of(given: argparse.Namespace) -> Config:
    base = Config()
    weights = {k.strip(): float(v) for k, _, v in (pair.partition("=") for pair in given.weights.split(",") if pair)}
    return Config(
        fields=dict(FIELD_WEIGHTS), weights=base.weights | weights, use_fusion=not given.no_fusion, phrase_weight=given.phrase_weight, use_category=not given.no_category,
        drop_overridden=given.drop_overridden, hold=not given.no_hold, router=given.router, clarify=given.clarify, ask=None if given.ask_attribute == "none" else given.ask_attribute,
    )


def tables(spark: SparkSession, given: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, products and intent cards of a catalog and a data set as JSON lines."""
    raw = stored(catalog.read_raw_products(spark, given.catalog), "raw")
    products = stored(raw.select("doc_id", *catalog.product_columns()), "products")
    return stored(catalog.read_samples(spark, given.dataset, products), "samples"), products, stored(simulate.intent_cards(catalog.customer_products(raw)), "cards")


def key() -> str | None:
    model_client.load_settings()
    return os.environ.get("MODEL_API_KEY")


def show(rows: DataFrame) -> None:
    print("\n".join(rows.toJSON().collect()))  # a row for each run


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "preflight":
        said = model_client.preflight(given.url, key(), given.model)
        print(said)
        return 0 if said == "ok" else 1
    spark = spark or SparkSession.builder.appName(f"quarrylight {given.command}").getOrCreate()
    if given.command == "query":
        out = queries()[given.query](spark, given.sf_dir)
        if given.out:
            catalog.write_results(out, given.out)
        else:
            out.show(20, truncate=80)
        return 0
    samples, products, cards = tables(spark, given)
    config = config_of(given)
    if given.command == "evaluate":
        out = stored(metrics.composite(metrics.summary(simulate.evaluate(samples, products, cards, config))), "summary")
        if given.baseline:
            row = F.lit("run").alias("config")
            delta = simulate.against(out.select(row, "*"), catalog.read_results(spark, given.baseline).select(row, "*")).drop("config")
            out = stored(out.crossJoin(F.broadcast(delta)), "summary")  # one row each
        if given.output:
            catalog.write_summary(out, given.output)
    elif given.command == "perturb":
        out = stored(simulate.ablation(samples, products, cards, {"run": config}, given.styles.split(",")), "styles")
    else:
        call = rerank.stub(given.fake_llm) if given.fake_llm else model_client.http_caller(given.url, key(), given.model) if given.url else None
        out = stored(simulate.integrated(samples, products, cards, {"without": (config, None), "with": (config, call)}), "runs")
    if given.output and given.command != "evaluate":
        catalog.write_results(out, given.output)
    show(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
