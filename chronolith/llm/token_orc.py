"""Token ids in ORC files: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids.

Texts are encoded by the tokenizers library (each distinct word once a worker; the vocabulary splits at white space, so words
are independent), an end id is appended, and Spark's ORC writer lays out rows in ascending id order: files and stripes are
ranges of ids, so stripes can be read in parallel, and ids, row indexes and Bloom filters let a lookup skip the others.

The one shuffle moves texts, before they are encoded, by ranges of (id, hash of the text), so rows of one id spread as well. A file holds
about FILE_BYTES of text unless a number of files is given. Each row is written with its place: how many ids its file holds before
it, and how many are its own; a reader adds the sums of the files before, one small row a file.

Nulls and empty texts are the end id alone; null ids come first; rows of one id are ordered by a hash of the text; an empty
table gives no rows. Input columns with the names of the results are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import broadcast_file
from .runtime import map_text, stage_path, tidy
from .wordtable import WordTable, joined

END_ID = 1
#: Bytes of text of a file, about.
FILE_BYTES = 32 << 20
_encoders: dict[int, WordTable] = {}


def encoder(text: str) -> WordTable:
    """One table of encoded words a worker."""
    key = hash(text)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executors' tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _encoders.clear()
        _encoders[key] = WordTable(lambda words: joined([e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]))
    return _encoders[key]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """id_col, ids (array of int, the end id last), place (ids of the partition's rows before) and n_tokens, in the order of df's rows."""
    shared = broadcast_file(df.sparkSession, vocabulary)

    def make():
        table, before = encoder(shared.value), 0

        def kernel(data, offsets):
            nonlocal before
            ids, at = table.ids(data, offsets)
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            place, before = before + at[:-1], before + int(at[-1])
            return [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids.astype("<i4"))), place, np.diff(at)]

        return kernel

    return map_text(df, text_col, {"ids": "array<int>", "place": "bigint", "n_tokens": "bigint"}, make, [id_col])


def in_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """id_col and text_col in ascending id order: as many ranges as files, sorted inside. Bounds come from ids and hashes only."""
    if not files:
        size = df.agg(F.sum(F.octet_length(df[text_col].cast("string")))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES))
    order = [F.col(id_col).asc_nulls_first(), "__tie"]
    tied = df.select(df[id_col], df[text_col]).withColumn("__tie", F.xxhash64(text_col))
    return tied.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("__tie")


def write_orc(df: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Rows of encode, in their order, a file a partition."""
    options = {"compression": "zstd", "orc.bloom.filter.columns": id_col, "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}
    df.write.options(**options).orc(path)


def read_orc(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all rows before), n_tokens and ids_crc32, from the files that write_orc made."""
    rows = spark.read.orc(path).withColumn("part", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int"))
    names = [id_col, "part", "place", "n_tokens", "ids_crc32"]

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            at, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names)

    kind = rows.schema[id_col].dataType.simpleString()
    each = rows.select(id_col, "part", "place", "ids").mapInArrow(tidy(run), f"`{id_col}` {kind}, part int, place bigint, n_tokens bigint, ids_crc32 bigint")
    # rows go on from file to file; of the files, only the column of lengths is read for this
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row a file
    return each.join(F.broadcast(first), "part").select(id_col, (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encode, write the files to path (by default a new folder beside the checkpoints) and read them back."""
    spark = df.sparkSession
    path = path or stage_path(spark, "tokens")
    write_orc(encode(in_order(df, id_col, text_col, files), vocabulary, id_col, text_col, end_id), path, id_col)
    return read_orc(spark, path, id_col)


def lookup(spark, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """Rows of the given ids: file statistics, row indexes and Bloom filters leave the other stripes unread."""
    return spark.read.orc(path).where(F.col(id_col).isin(ids))
