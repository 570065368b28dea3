"""Documents with what can go wrong: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

WORDS = "the of and to in is that was for on with as by at from river stone cloud paper garden window market letter number summer".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1, count=24):
    rng = random.Random(seed)
    base = [text(rng, rng.randint(30, 90)) for _ in range(count)]
    rows = [(k, t, "s%d" % (k % 3)) for k, t in enumerate(base)]
    rows += [(100, base[0], "s0"), (101, base[0], "s1"), (102, base[1] + " extra words here", None), (103, None, "s0"), (104, "", None), (105, " \t\n ", "s2")]
    rows += [(106, "one", "s2"), (107, "two words", "s1"), (108, ("naïve café ☃ 漢字 " * 900).strip(), "s0"), (109, "x" * 5000, "s1"), (110, text(rng, 4000), "s2")]
    rows += [rows[3], rows[3], (111, base[2].replace("river", "stone", 1), "s0"), (112, base[3].upper(), "s1")]
    return rows


SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows=None, clash=()):
    """The rows, dealt over several partitions, with extra columns of the given names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(4, "doc_id")
    return df.withColumns({c: F.lit("clash") for c in clash}) if clash else df
