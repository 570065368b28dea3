"""Mixing sources to target weights by hash-threshold histograms, without a sort.

Every row has a fixed 60-bit hash. Tokens are summed by source and leading hash bits; a prefix sum over these few sums finds
the bucket in which a source's budget ends. Only that boundary bucket is refined by the next bits, and again, until the
threshold is one hash value. A row is taken when its hash lies under its source's threshold, so a smaller budget takes a
subset of what a larger one takes. Budgets above a source's size take every row whole as often as they hold it, and the rest
by threshold.

Shuffles carry sums by (source, bucket) only, at most BUCKETS a source whatever the rows; the small table of sources is joined
by broadcast when Spark's statistics prove it small, and by a shuffle else. DataFrame functions throughout.

A null source is a source of its own, last in order; null and empty texts have size 0 and are taken as often as their source
is; rows share their hash with those of the same id, and where the boundary falls among several of these, a hash of their texts and
places decides row by row; an empty table gives no rows. Input columns with the names of the results are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import drop_path, stage_path, staged

BITS, LEVELS = 12, 5
BUCKETS = 1 << BITS
WEIGHTS, CAP = (1, 2, 3), 3.0


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09 to 0x0D: where such a run starts, after the others are made spaces."""
    plain = F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def row_hash(*parts: Column) -> Column:
    """60 bits of the MD5 digest of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size and target: shares of the sum of sizes by repeating weights, in order of code points, null last.

    No target exceeds cap times its source's size; what is over goes to the others by weight. With a level l, target =
    min(cap * size, l * weight); sources reach their caps in order of cap * size / weight, so l follows from prefix sums.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    every = Window.partitionBy()
    before, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    t = t.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    # sources before the first that isn't full have their cap; that one's level holds for it and all after
    t = t.withColumn("open", F.max(F.when(~F.col("full"), 1).otherwise(0)).over(ratio.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("final", F.first(F.when(F.col("open") == 1, F.col("level")), True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.when(F.col("open") == 0, F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight"))).alias("target"))


def split_lumps(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """cut (source, threshold, edge, rest) with more: of the rows at the edge, those whose hash ``fine`` is under it are taken too.

    Where a single row stands at the edge, the threshold has decided on it. rows: source, size, hash, fine.
    """
    c = cut.withColumnRenamed("source", "__key")
    at = rows.join(c, rows["source"].eqNullSafe(F.col("__key")) & (rows["hash"] == F.col("edge")))
    lumps = staged(at.select("source", "size", "fine"), "lumps")
    several = staged(lumps.groupBy("source").agg(F.count("*").alias("rows")).where("rows > 1"), "several")  # a row a source
    none = cut.withColumn("more", F.lit(0).cast("long"))
    if not several.limit(1).count():
        return none
    keys = several.select(F.col("source").alias("__key"))
    open_ = cut.join(keys, cut["source"].eqNullSafe(F.col("__key")), "left_semi")
    some = lumps.join(keys, lumps["source"].eqNullSafe(F.col("__key")), "left_semi")
    fine = thresholds(some, open_.select("source", F.col("rest").alias("budget")), hashed="fine").select(F.col("source").alias("__key"), F.col("threshold").alias("__more"))
    out = cut.join(fine, cut["source"].eqNullSafe(F.col("__key")), "left")
    whole = F.when(F.col("__more").isNull(), F.col("threshold")).otherwise(F.col("edge"))
    return out.select("source", whole.alias("threshold"), "edge", "rest", F.coalesce("__more", F.lit(0)).alias("more"))


def thresholds(rows: DataFrame, budgets: DataFrame, key: str = "source", size: str = "size", hashed: str = "hash") -> DataFrame:
    """key and threshold: rows whose hash is under it hold about the budget (long column ``budget``) of their key; edge, the hash
    at which the budget ends (null where it doesn't), and rest, what is left of the budget there.

    rows: key, size and a 60-bit hash. Level by level, sums of the boundary bucket only are refined; at the last, the single
    hash value at the boundary is taken if that comes nearer.
    """
    state = budgets.select(key, "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("taken"))
    spark = rows.sparkSession
    path = stage_path(spark, "budgets")
    cached = staged(state, "budgets", path)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        prefix = F.shiftright(F.col(hashed), shift + BITS)
        inside = rows.join(cached.withColumnRenamed(key, "__key").withColumn("__at", F.shiftright("low", shift + BITS)), rows[key].eqNullSafe(F.col("__key")) & (prefix == F.col("__at")))
        sums = inside.groupBy(key, F.shiftright(F.col(hashed), shift).alias("bucket")).agg(F.sum(size).alias("n"))
        order = Window.partitionBy(key).orderBy("bucket")
        sums = sums.withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        joined = cached.alias("s").join(sums.alias("b"), F.col(f"s.{key}").eqNullSafe(F.col(f"b.{key}")), "left")
        # the bucket in which the budget ends is the first whose sum exceeds it; without one, all of this range is taken
        over = F.col("s.taken") + F.col("b.sum") > F.col("s.budget")
        found = joined.groupBy(f"s.{key}", "s.budget", "s.low", "s.taken").agg(
            F.min(F.when(over, F.col("b.bucket"))).alias("at"), F.min_by("b.n", F.when(over, F.col("b.bucket"))).alias("n"),
            F.min(F.when(over, F.col("b.sum") - F.col("b.n"))).alias("before"), F.sum("b.n").alias("all"),
        )
        new_low = F.shiftleft(F.col("at"), shift)
        end = F.shiftleft(F.shiftright(F.col("low"), shift + BITS) + 1, shift + BITS)
        base = found.withColumn("below", F.col("taken") + F.coalesce("before", F.lit(0)))
        if level == LEVELS - 1:
            near = F.col("below") + F.col("n") - F.col("budget") < F.col("budget") - F.col("below")
            last = F.when(F.col("at").isNull(), end).when(near, new_low + 1).otherwise(new_low)
            edge = F.when(F.col("at").isNotNull(), new_low)
            out = staged(base.select(key, last.alias("threshold"), edge.alias("edge"), (F.col("budget") - F.col("below")).alias("rest")), "thresholds")
            drop_path(spark, path)
            return out
        taken = F.when(F.col("at").isNull(), F.col("taken") + F.coalesce("all", F.lit(0))).otherwise(F.col("below"))
        old, path = path, stage_path(spark, "budgets")
        cached = staged(base.select(key, "budget", F.coalesce(new_low, end).alias("low"), taken.alias("taken")), "budgets", path)
        drop_path(spark, old)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, id_col, size, source_size, target, copies (how often the row is taken) and taken (copies * size)."""
    keep = [c for c in (keep or []) if c not in (id_col, "size", "source_size", "target", "copies", "taken")]
    # the leading half from the text, the rest from the row's place
    fine = F.shiftleft(F.pmod(F.xxhash64(df[text_col].cast("string")), F.lit(1 << 30)), 30) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    rows = df.select(*[df[c].alias(f"kept_{c}") for c in keep], df[id_col].alias("id"), df[source_col].cast("string").alias("source"), word_count(df[text_col]).alias("size"), row_hash(df[id_col]).alias("hash"), fine.alias("fine"))
    small = staged(rows.select("id", "source", "size", "hash", "fine"), "mix")
    rows = rows if keep else small
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = staged(targets(sizes, weights, cap), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    cut = split_lumps(small, thresholds(small, goal))
    goal = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source"))).select(F.col("g.source").alias("goal_key"), "source_size", "target", "whole", "threshold", "edge", "more")
    out = rows.join(goal, rows["source"].eqNullSafe(F.col("goal_key")))
    under = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("edge")) & (F.col("fine") < F.col("more")))
    copies = (F.col("whole") + F.when(under, 1).otherwise(0)).cast("long")
    return out.select(*[F.col(f"kept_{c}").alias(c) for c in keep], F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([1.0, 2.0, 3.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, {CAP}::DOUBLE * source_size AS most, row_number() OVER (ORDER BY {CAP}::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT min(k) AS first FROM l WHERE most > level * w),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR k < first THEN most ELSE least(most, (SELECT level FROM l WHERE k = first) * w) END AS target FROM l, f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT *, round(target - whole * source_size)::BIGINT AS budget FROM g),
h AS (SELECT source, hash, sum(size)::BIGINT AS n FROM d GROUP BY ALL),
c AS (SELECT source, hash, n, (sum(n) OVER (PARTITION BY source ORDER BY hash))::BIGINT AS upto FROM h),
x AS (SELECT c.source, min(hash) AS edge, min_by(n, hash) AS n, min_by(upto - n, hash) AS below, any_value(budget) AS budget FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE upto > budget GROUP BY c.source),
e AS (SELECT b.*, CASE WHEN edge IS NULL THEN 1::BIGINT << 60 WHEN below + x.n - x.budget < x.budget - below THEN edge + 1 ELSE edge END AS threshold FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (whole + CASE WHEN hash < threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source"""
