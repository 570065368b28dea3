"""Sinks: append once, fill once, change only what differs, replace, keep for a time, checksum.

Each returns the table's new rows as a DataFrame; ``write`` stores them. First writers win and records are never edited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_once(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of new whose key isn't in existing, the first of each key in the given order."""
    first = new.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")
    return first.join(existing.select(*key), key, "left_anti")


def fill_once(existing: DataFrame, fills: DataFrame, key: list[str], columns: list[str], guard: str) -> DataFrame:
    """existing with columns filled from fills where the guard column is null."""
    named = fills.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = existing.join(named, key, "left")
    return out.select(*[F.when(F.col(guard).isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def upsert_changed(existing: DataFrame, new: DataFrame, key: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(the table after the upsert, the rows that changed it)."""
    changed = new.alias("n").join(existing.alias("e"), [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in key], "left").where(~F.col(f"n.{value}").eqNullSafe(F.col(f"e.{value}"))).select("n.*")
    return existing.join(changed.select(*key), key, "left_anti").unionByName(changed), changed


def retained(df: DataFrame, time: str, now: int, keep: int) -> DataFrame:
    return df.where(F.col(time) >= now - keep)


def checksum(df: DataFrame) -> DataFrame:
    """rows and a digest that doesn't depend on the order of rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    marks = df.select(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)").alias("m"))
    return marks.agg(F.count("*").alias("n"), F.sum("m").alias("digest"))


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet; mode append, overwrite (a table of one document) or errorifexists (a report written once)."""
    df.write.mode(mode).parquet(path)


def digest(df: DataFrame, key: str, chunk: int = 1000) -> DataFrame:
    """n and sha256 of the sorted rows: rows are joined and hashed by chunks of an integer key, and hashes twice again, so that no
    task holds more than a chunk's rows, whatever the table's size."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    first = df.select(F.floor(F.col(key) / chunk).alias("a"), line.alias("line")).groupBy("a").agg(F.count("*").alias("n"), joined("line").alias("sha"))
    second = first.groupBy(F.floor(F.col("a") / chunk).alias("b")).agg(F.sum("n").alias("n"), joined("sha").alias("sha"))
    return second.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined("sha").alias("sha256"))


class Ledger:
    """A table of records that can only grow: rows are added once by key, never edited or removed."""

    def __init__(self, spark, path: str, key: list[str], order: list[str], schema: str):
        self.spark, self.path, self.key, self.order, self.schema = spark, path, key, order, schema
        spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, new: DataFrame) -> None:
        """The rows whose key is new, the first of each; columns must be the table's."""
        known = [c.name for c in self.rows().schema]
        if sorted(new.columns) != sorted(known):
            raise ValueError(f"columns are {new.columns}, not {known}")
        append_once(self.rows(), new.select(*known), self.key, self.order).write.mode("append").parquet(self.path)


def bootstrap(spark, tables: dict[str, str]) -> list[str]:
    """Create the catalog tables (name: DDL of columns) that are missing, in order; returns which were."""
    made = [name for name in tables if not spark.catalog.tableExists(name)]
    for name in made:
        spark.sql(f"CREATE TABLE {name} ({tables[name]}) USING parquet")
    return made
