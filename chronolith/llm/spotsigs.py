"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Anchors are common function words; each anchor's signature is the chain of the CHAIN content words that follow it, other
anchors skipped. A text's fingerprint is the sorted set of its signatures' 32-bit hashes, in hex. Likeness of two
fingerprints is the Jaccard measure of the sets. A text without any signature has its whole word sequence as its one
signature, a text without words none; two texts without words are alike (1).

near_pairs finds pairs over a whole table: sets are partitioned by length, so that a set only meets partitions whose lengths
allow the threshold; within a partition pairs meet through their rarest signatures (prefix filter), and the Jaccard measure
is computed only for pairs whose lengths still allow it. Equal fingerprints are one class, not pairs.

DataFrame functions throughout. Texts move in one shuffle, by ranges of ids, when texts are compared with their neighbours.

Nulls and empty texts have the empty fingerprint; null ids come last in descending order; rows of one id are ordered by a hash
of the text; an empty table gives no rows; input columns with the names of the results are not read.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import staged

# Common function words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from has have in is it of on or that the this to was were what which with
als auch auf das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von zu
au aux avec ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une
al como con de del el ella en es está la las lo los más no para por que se su un una y
""".split()
CHAIN = 3
PUNCTUATION = ".,;:!?\"'()[]{}|*#$%&<>=+-_/\\"
SPACES = "\t\n\x0b\x0c\r"
#: Rows of about this many make a range of ids when texts are compared with their neighbours.
RANGE_ROWS = 2000


def words(text: Column) -> Column:
    """Words in lower case, without punctuation."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), SPACES + PUNCTUATION, " " * len(SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def is_anchor(word: Column) -> Column:
    return word.isin(*dict.fromkeys(ANCHORS))


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``: the sorted distinct hashes (array of int) of the signatures of a text column."""
    w, content, anchors = f"__w_{out}", f"__c_{out}", f"__a_{out}"
    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumn(content, F.filter(w, lambda x: ~is_anchor(x)))
    # the k-th anchor at place p (both from 0) has p - k content words before it
    df = df.withColumn(anchors, F.array_compact(F.transform(w, lambda x, i: F.when(is_anchor(x), i))))
    chains = F.transform(anchors, lambda p, k: F.when(p - k + CHAIN <= F.size(content), F.hash(F.slice(content, p - k + 1, CHAIN))))
    found = F.array_sort(F.array_distinct(F.array_compact(chains)))
    whole = F.when(F.size(w) > 0, F.array(F.hash(F.col(w)))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, found).withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(w, content, anchors)


def spelled(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union).cast("double")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint."""
    source = df.select(df[id_col], df[text_col].cast("string").alias("__text"))
    return signatures(source, "__text", "__s").select(id_col, spelled(F.col("__s")).alias("fingerprint"))


def bounds_under(value: Column, bounds: list, kind: str, step: int = 100) -> Column:
    """How many of the sorted bounds are at or under a value, found among every step-th bound first."""
    grid = lambda values: F.array(*[F.lit(b) for b in values]).cast(f"array<{kind}>")
    under = lambda values: F.size(F.filter(values, lambda b: b <= value))
    coarse = under(grid(bounds[::step]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + under(F.slice(grid(bounds), (coarse - 1) * step + 1, step)))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and next_text: the text of the next row in descending order of ids, of the first row after the last.

    Rows are dealt into ranges of ids; the first row of a range also goes, as a guest, to the range before it.
    """
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    n, low, high = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    parts = max(1, min(n // RANGE_ROWS, 10_000))
    if n and low is not None and high > low:
        bounds = sorted({*rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts + 100)).first()[0]})
    else:
        bounds = []
    # the range of an id is the number of bounds at or under it; ranges are met in descending order
    kind = df.schema[id_col].dataType.simpleString()
    part = F.when(F.col("id").isNull(), -1).otherwise(bounds_under(F.col("id"), bounds, kind)) if bounds else F.lit(0)
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("part", part.cast("int"))
    order = [F.col("id").desc_nulls_last(), F.col("tie").desc()]
    # the first row of each range, by (id, tie): at most a row a range
    heads = keyed.select("id", "tie", "part").groupBy("part").agg(F.max(F.struct("id", "tie")).alias("head"))
    heads = heads.select("part", F.col("head.id").alias("hid"), F.col("head.tie").alias("htie")).orderBy(F.desc("part")).collect()
    guests = keyed.sparkSession.createDataFrame(
        [(h.part, h.hid, h.htie, heads[k - 1].part) for k, h in enumerate(heads)], f"hpart int, hid {kind}, htie long, goes int"
    )
    visit = keyed.join(F.broadcast(guests), (F.col("part") == F.col("hpart")) & F.col("id").eqNullSafe(F.col("hid")) & (F.col("tie") == F.col("htie")))
    visit = visit.dropDuplicates(["part", "id", "tie"]).select("id", "text", "tie", F.col("goes").alias("part"), F.lit(1).alias("guest"))
    both = keyed.select("id", "text", "tie", "part", F.lit(0).alias("guest")).unionByName(visit)
    return both.withColumn("next_text", F.lead("text").over(Window.partitionBy("part").orderBy("guest", *order))).where("guest = 0")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text.
    """
    t = with_next(df, id_col, text_col)
    t = t.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    t = t.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("half")), F.substring(F.col("next_text"), F.lit(1), F.col("half"))))
    for text, out in (("text", "own"), ("edited", "changed"), ("next_text", "next")):
        t = signatures(t, text, out)
    return t.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("own")).alias("fingerprint"), spelled(F.col("changed")).alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("changed")).alias("near_edited"), jaccard(F.col("own"), F.col("next")).alias("near_next"),
    )


def length_parts(threshold: float, longest: int) -> list[int]:
    """The least length of each partition: lengths that allow the threshold are in one partition or in neighbouring ones."""
    t, starts = Fraction(str(threshold)), [1]
    while starts[-1] <= longest:
        starts.append(floor(starts[-1] / t) + 1)
    return starts


def near_pairs(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): pairs id_a < id_b of class ids with their likeness, at least threshold; classes id_col and class_id,
    the smallest id with an equal fingerprint. Empty fingerprints are in no pair."""
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("__text"))
    sets = signatures(source, "__text", "sigs").select("id", "sigs")
    sets = staged(sets.withColumn("key", F.sha2(spelled(F.col("sigs")), 256)), "spotsigs")
    reps = staged(sets.where(F.size("sigs") > 0).groupBy("key").agg(F.min("id").alias("class_id"), F.first("sigs").alias("sigs")), "spotsigs")
    classes = sets.join(reps.select("key", "class_id"), "key", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))
    n = F.size("sigs")
    # partitions of lengths: a set of length n meets lengths from threshold * n to n / threshold, its own partition or a neighbour
    starts = length_parts(threshold, reps.agg(F.max(n)).first()[0] or 1)
    reps = reps.withColumn("n", n).withColumn("part", F.size(F.filter(F.array(*[F.lit(x) for x in starts]), lambda x: x <= F.col("n"))))
    freq = reps.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("f"))
    ranked = reps.select("class_id", "n", "part", F.explode("sigs").alias("sig")).join(freq, "sig")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("f", "sig"))
    prefix = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("f > 1")
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["sig", "part"]).where(ordered & (F.col("na") >= threshold * F.col("nb"))).select("a", "b").distinct()
    sides = [reps.select(F.col("class_id").alias(s), F.col("sigs").alias(f"s{s}")) for s in "ab"]
    pairs = found.join(sides[0], "a").join(sides[1], "b").withColumn("likeness", jaccard(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "likeness"), classes
