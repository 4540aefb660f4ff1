"""Token ids as Parquet list columns in ascending document order, and reading them back.

Each file is one range of doc_id. A row has its ids, their number and where they start in the file, so
that a reader of lengths or of some documents touches only those columns and pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripledger.llm.arrow_rows import id_lists, list_bytes, map_rows, slices
from tripledger.llm.word_bpe import codec

#: Row groups of so many bytes; pages of so many rows at most, each with its entry in the page index.
ROW_GROUP_BYTES, ROWS_PER_PAGE = 64 << 20, 1_000


def in_ranges(docs: DataFrame, tie: Column) -> DataFrame:
    """docs dealt into ascending ranges of (doc_id, tie), null first, as repartitionByRange would.

    The limits are quantiles of doc_id alone, so no text is read to find them. A doc_id that holds more rows than a range
    spans several limits; its rows are dealt over the ranges between them by tie.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = [i / parts for i in range(1, parts)]
    limits = docs.agg(F.percentile_approx(place, cuts, max(10_000, 20 * parts))).first()[0] if cuts else None
    if not limits:
        return docs.repartition(1)
    below = lambda test: F.size(F.filter(F.lit(limits).cast("array<bigint>"), test))
    first, last = below(lambda x: x < place), below(lambda x: x <= place)
    share = tie.cast("double") / float(1 << 64) + 0.5  # falls in [0, 1], ascending with tie
    return docs.repartitionById(parts, F.least(last, first + F.floor(share * (last - first + 1))).cast("int"))


def write(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str, row_group_bytes: int = ROW_GROUP_BYTES, rows_per_page: int = ROWS_PER_PAGE
) -> None:
    """Encode and write docs (doc_id, text; other columns are not read) to a new folder.

    Rows go by ascending doc_id (null first), rows of one doc_id by a hash of the text; equal rows are all
    kept. A null text is written as the end id alone. Ids are dictionary encoded, and delta encoded
    where a dictionary would not pay (data page version 2).
    """
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in slices(batches):
            ids = [x + end for x in codec(vocabulary).encode_batch(batch.column(1).to_pylist())]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(starts), id_lists(ids)], ["doc_id", "n_tokens", "file_start", "ids"])

    tie = F.xxhash64("text")
    (
        in_ranges(docs.select(F.col("doc_id").cast("long"), "text"), tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(encoded, "doc_id long, n_tokens long, file_start long, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", rows_per_page)
        .parquet(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files: (doc_id, file_no, n_tokens, file_start, ids)."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = spark.read.schema("doc_id long, n_tokens long, file_start long, ids array<int>").parquet(folder)
    return rows.withColumn("file_no", F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"))


def file_starts(rows: DataFrame) -> DataFrame:
    """Ids before each file, from the lengths alone: one row for each file."""
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("in_file"))
    before = F.sum("in_file").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("file_no", F.coalesce(before, F.lit(0)).alias("before"))


def digest(rows: DataFrame) -> DataFrame:
    """Start, length and checksum of each document, from the ids in the files."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = list_bytes(batch.column(3))
        crc = pa.array(np.fromiter(map(zlib.crc32, lists), np.int64, len(lists)))
        n = pa.array(np.fromiter(map(len, lists), np.int64, len(lists)) // 4)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], n, crc], ["doc_id", "file_no", "file_start", "n_tokens", "ids_crc32"])

    summed = map_rows(
        rows.select("doc_id", "file_no", "file_start", "ids"), make, "doc_id long, file_no long, file_start long, n_tokens long, ids_crc32 long", 3
    )
    return summed.join(file_starts(rows), "file_no").select(
        "doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )
