"""Sharding by balanced label propagation: iterative Spark joins move linked rows towards their neighbours' shards.

Links are groups: rows of one group are linked with each other, so a group of n takes n rows, not n * n. Rows start spread by
hash. In each round a row asks for the shard that holds most of its neighbours (all of a group ask for the same one), and
those with most to gain move, up to the room that each shard has: thresholds come from histograms of (shard, gain, hash), not
from sorting rows. At the end, rows with the fewest links beside them leave full shards for others until sizes are even; hash
thresholds refined to the single row pick them, so a shard ends within about one row's size of its share.

Law ``bytes``: sizes near equal. A group larger than a shard is split, by necessity.

All joins on groups are salted, so a group with a third of all rows spreads over tasks; histograms are summed before they are
shuffled; what is broadcast or collected has a row for each shard and bucket, at most shards * 4096. Each round's result is a
table in the shared folder. DataFrame functions throughout.

All that is drawn, the start, the order of moves and the slots, follows from a row's id and text, so the result doesn't depend on files
or partitions; only which of several rows with one id and one text stands where does. cut_links counts the links between shards.

Nulls and empty texts are equal texts of size 1; repeated rows are rows of their own; an empty table gives no rows; input
columns with the names of the results are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import BITS, LEVELS, row_hash, thresholds
from .runtime import drop_path, stage_path, staged

SHARDS, ROUNDS, SLACK, EVENINGS = 8, 4, 0.2, 2
SALTS, FINE = 16, 256
GAINS = 8


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def own_salt(node: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("salt")), F.lit(SALTS)).cast("int")


def loads(state: DataFrame, shards: int) -> list[int]:
    got = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row a shard
    return [got.get(k, 0) for k in range(shards)]


def by_shard(values: list[float], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), shard.cast("int") + 1)


def votes(state: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """node and v0, v1, ...: how many rows of its groups, itself included, are in each shard; lead: breaks ties."""
    at = members.join(state.select("node", "shard"), "node")
    each = at.groupBy("group", "shard").agg(F.count("*").alias("n"))
    wide = each.groupBy("group").agg(*[F.sum(F.when(F.col("shard") == k, F.col("n")).otherwise(0)).alias(f"v{k}") for k in range(shards)])
    wide = salted(wide.withColumn("lead", F.xxhash64("group")))
    seen = members.withColumn("salt", own_salt(F.col("node"))).join(wide, ["group", "salt"])
    return seen.groupBy("node").agg(F.min("lead").alias("lead"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(shards)])


def round_moves(state: DataFrame, members: DataFrame, shards: int, cap: float) -> tuple[DataFrame, list[str]]:
    """node and shard of the rows that move, the best gains that fit the room of each shard; and what can be deleted after them."""
    v = votes(state, members, shards).join(state, "node")
    load = loads(state, shards)
    # a full shard takes nobody in; of shards with equal votes, one with room comes first, then one by a hash of the group
    best = reduce(F.greatest, [
        F.struct(F.when((F.col("shard") == k) | F.lit(load[k] < cap), F.col(f"v{k}")).otherwise(-1).alias("n"), F.lit(load[k] < cap).alias("open"), F.pmod(F.lit(k) + F.col("lead"), F.lit(shards)).alias("tie"), F.lit(k).alias("to"))
        for k in range(shards)
    ])
    here = reduce(lambda a, k: F.when(F.col("shard") == k, F.col(f"v{k}")).otherwise(a), range(shards), F.lit(0))
    wish = v.withColumn("best", best).withColumn("gain", F.col("best.n") - here).where(F.col("best.to") != F.col("shard"))
    # classes of gain by powers of two, the best first, then a hash
    rank = GAINS - 1 - F.least(F.floor(F.log2(F.greatest(F.col("gain"), F.lit(0)) + 1)), F.lit(GAINS - 1))
    wish = wish.select("node", "size", F.col("best.to").alias("to"), (rank * FINE + F.pmod(F.xxhash64("tie", F.lit("round")), F.lit(FINE))).cast("int").alias("bucket"))
    path = stage_path(state.sparkSession, "wishes")
    wish = staged(wish, "wishes", path)
    room = by_shard([max(0.0, cap - x) for x in load], F.col("to"))
    sums = wish.groupBy("to", "bucket").agg(F.sum("size").alias("n"))  # at most shards * GAINS * FINE rows
    upto = F.sum("n").over(Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    fits = sums.withColumn("upto", upto).where(F.col("upto") <= room).select("to", "bucket")
    return wish.join(F.broadcast(fits), ["to", "bucket"]).select("node", F.col("to").alias("new")), [path]


def moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    return state.join(moves, "node", "left").withColumn("shard", F.coalesce("new", "shard")).drop("new")


def even_moves(state: DataFrame, members: DataFrame, shards: int) -> tuple[DataFrame | None, list[str]]:
    """node and shard of the rows that leave shards over their share for those under it, rows with few links beside them first; and what
    can be deleted after them."""
    load = loads(state, shards)
    share = sum(load) / shards
    over, under = [max(0, round(x - share)) for x in load], [max(0, round(share - x)) for x in load]
    if not any(over) or not any(under):
        return None, []
    spark = state.sparkSession
    paths = [stage_path(spark, name) for name in ("open", "leaving")]
    v = votes(state, members, shards).join(state.select("node", "shard"), "node")
    here = reduce(lambda a, k: F.when(F.col("shard") == k, F.col(f"v{k}")).otherwise(a), range(shards), F.lit(0))
    links = v.select("node", F.least(F.floor(F.log2(here + 1)) + 1, F.lit(15)).cast("long").alias("ties"))
    width = BITS * LEVELS - 4
    spread = F.shiftrightunsigned(F.xxhash64("tie", F.lit("even")), 64 - width)
    open_ = state.where(by_shard(over, F.col("shard")) >= F.col("size")).join(links, "node", "left")
    rows = staged(open_.select("node", "tie", "size", "shard", (F.shiftleft(F.coalesce("ties", F.lit(0)).cast("long"), width) + spread).alias("hash")), "open", paths[0])
    budgets = spark.createDataFrame([(k, int(x)) for k, x in enumerate(over) if x], "shard int, budget long")
    cut = thresholds(rows, budgets, "shard")
    leaving = rows.join(F.broadcast(cut), "shard").where(F.col("hash") < F.col("threshold"))  # a row a shard
    leaving = staged(leaving.select("node", "size", F.shiftrightunsigned(F.xxhash64("tie", F.lit("to")), 64 - BITS * LEVELS).alias("hash")), "leaving", paths[1])
    # nested budgets: what goes to the first shard with room, to the first two, ...
    nested, total = [], 0
    for k, x in enumerate(under):
        if x:
            total += x
            nested.append((k, total))
    grid = spark.createDataFrame(nested, "to int, budget long")
    cut = thresholds(leaving.withColumn("to", F.explode(F.array(*[F.lit(k) for k, _ in nested]))), grid, "to")
    bounds = sorted((r.to, r.threshold) for r in cut.collect())  # a row a shard
    to = reduce(lambda rest, b: F.when(F.col("hash") < b[1], b[0]).otherwise(rest), reversed(bounds[:-1]), F.lit(bounds[-1][0]))
    return leaving.select("node", to.cast("int").alias("new")), paths


def propagate(nodes: DataFrame, members: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, evenings: int = EVENINGS) -> DataFrame:
    """node, tie, size and shard. nodes: node (unique long), tie (long, for all that is drawn) and size; members: node and group, for
    groups of two rows or more."""
    spark = nodes.sparkSession
    first = nodes.select("node", "tie", "size", F.pmod(F.xxhash64("tie", F.lit("start")), F.lit(shards)).cast("int").alias("shard"))
    path = stage_path(spark, "state")
    state = staged(first, "state", path)
    cap = (1 + slack) * sum(loads(state, shards)) / shards
    steps = [lambda s: round_moves(s, members, shards, cap)] * rounds + [lambda s: even_moves(s, members, shards)] * evenings
    for step in steps:
        moves, spent = step(state)
        if moves is not None:
            new = stage_path(spark, "state")
            state = staged(moved(state, moves), "state", new)
            for old in (path, *spent):
                drop_path(spark, old)
            path = new
    return state


def cut_links(state: DataFrame, members: DataFrame) -> DataFrame:
    """One row: links (pairs of rows of a group) and cut (those whose rows are in different shards), from counts by group and shard."""
    at = members.join(state.select("node", "shard"), "node").groupBy("group", "shard").agg(F.count("*").alias("n"))
    each = at.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    whole = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return each.agg(F.coalesce(whole, F.lit(0.0)).cast("long").alias("links"), F.coalesce(whole - F.sum("inside"), F.lit(0.0)).cast("long").alias("cut"))


def tied(base: DataFrame) -> DataFrame:
    """base (id, group, node) with tie: a hash of id and group; where several rows share both, of the node as well."""
    again = staged(base.groupBy("id", "group").count().where("count > 1").select(F.col("id").alias("__id"), F.col("group").alias("__group"), F.lit(True).alias("__again")), "again")
    both = base.join(again, base["id"].eqNullSafe(F.col("__id")) & (base["group"] == F.col("__group")), "left")
    return both.withColumn("tie", F.xxhash64("id", "group", F.when(F.col("__again"), F.col("node")))).drop("__id", "__group", "__again")


def shard_documents(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null: law is bytes). Equal
    texts are linked."""
    raw = F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary")
    base = df.select(df[id_col].alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("group"))
    base = staged(base.withColumn("node", F.monotonically_increasing_id()), "sizes")
    base = staged(tied(base), "tied")
    large = salted(base.groupBy("group").count().where("count > 1").select("group"))
    members = staged(base.select("node", "group", own_salt(F.col("node")).alias("salt")).join(large, ["group", "salt"]).select("node", "group"), "members")
    state = propagate(base, members, shards)
    placed = base.drop("size", "tie").join(state, "node").withColumn("hash", row_hash(F.col("tie"))).withColumn("bucket", F.shiftright("hash", 48))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards * 4096 rows
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("hash", "node")) - 1
    out = placed.withColumn("inside", inside).join(F.broadcast(first), ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
