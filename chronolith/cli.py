"""Reports on a folder of tables as JSON lines: python -m chronolith.cli KIND --sf DIR [--at HOUR] [--limit N] [--before HOUR] [--hour HOUR]."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import views
from .plans.base import hourly
from .plans.evaluation import record
from .session import session


def known(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, int]:
    predictions, outcomes, _ = record(spark, a.sf)
    at = a.at if a.at is not None else (predictions.agg(F.max("created_h")).first()[0] or 0)
    return *views.known_at(predictions, outcomes, at), at


def latest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return known(spark, a)[0].orderBy(F.desc("h"), "key").limit(1)


def runs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    p = known(spark, a)[0]
    return (p if a.before is None else p.where(F.col("h") < a.before)).orderBy(F.desc("h"), "key").limit(a.limit)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    p, o, at = known(spark, a)
    return views.run_view(p.where(F.col("h") == a.hour), o, [1, 24], at).orderBy("key", "horizon")


def statistics(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    p, o, at = known(spark, a)
    return views.horizon_table(views.run_view(p, o, [1, 24], at)).orderBy("horizon")


def health(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    c = hourly(spark, a.sf).where(F.col("h") + 1 <= known(spark, a)[2])
    return views.gaps(c.select("key", "h")).groupBy("key").agg(F.count("*").alias("gaps"), F.sum("missing").alias("missing")).orderBy("key")


KINDS: dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame]] = {"latest": latest, "runs": runs, "run": run, "statistics": statistics, "health": health}


def main(args: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("kind", choices=[*KINDS, "all"])
    parser.add_argument("--sf", required=True)
    parser.add_argument("--at", type=int)
    parser.add_argument("--limit", type=int, default=24)
    parser.add_argument("--before", type=int)
    parser.add_argument("--hour", type=int)
    a = parser.parse_args(args)
    if a.kind == "run" and a.hour is None:
        parser.error("run needs --hour")
    spark = spark or session()
    for name in [a.kind] if a.kind != "all" else [k for k in KINDS if k != "run"]:
        for row in KINDS[name](spark, a).toJSON().collect():  # reports of a few rows
            print(f'{{"kind":"{name}","row":{row}}}', file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
