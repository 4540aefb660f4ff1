"""Line deduplication over levelled sorted runs of line hashes.

Batches of documents come one after another. The long lines of a batch are reduced to one entry a key (documents
holding it, largest doc_id) and anti-joined by merging with the runs of earlier batches: keys that no run
knows get their holder from this batch, known ones add only to the count. The entries become a new sorted
run of level 0; so many runs of one level are compacted into one of the next. Runs are bucketed by key,
so an anti-join shuffles the batch alone; a run is shuffled again only when it is compacted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.materialize import discard, materialize, scratch_path
from tripledger.llm.arrow_rows import slices

#: Keys shorter than this many code points never count; a line goes when its key is in this many documents.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Runs of one level that are compacted into one of the next.
FANOUT = 3
#: Batches that a table of documents is dealt into.
BATCHES = 4
#: Rows without doc_id count as one document before all others.
NO_ID = -(1 << 63)
_SPACE = b" \t\n\x0b\x0c\r"


def keyed_lines(raw: bytes, least_chars: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for lines whose key is too short.

    bytes.lower changes A-Z alone, and all stripped characters are ASCII.
    """
    out: list[bytes | None] = []
    for line in raw.lower().split(b"\n"):
        key = line.strip(_SPACE)
        long = len(key) >= least_chars and (len(key) >= 4 * least_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row for each row and different long key: (doc_id, part, key). docs: doc_id, part, text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            at, keys = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = {k for k in keyed_lines(text.encode("utf-8"), least_chars) if k} if text else ()
                at += [i] * len(own)
                keys += own
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys, pa.binary())], ["doc_id", "part", "key"])

    return docs.select("doc_id", "part", "text").mapInArrow(run, "doc_id long, part long, key binary")


class LineRuns:
    """The levelled runs: tables (key, n_docs, holder) sorted and bucketed by key, in the shared folder.

    A key has a holder in the run of the batch that saw it first and null in later ones, until compaction
    brings its rows together.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout: at least 2 runs make one of the next level")
        self.spark, self.fanout = spark, fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def _names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = scratch_path(self.spark)
        entries.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self._paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self._paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """The rows of several runs brought together. Read as plain files: over a union of bucketed tables this
        Spark version leaves out the shuffle although the files of one bucket do not meet in one task."""
        rows = self.spark.read.schema("key binary, n_docs long, holder long").parquet(*[self._paths[n] for n in names])
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def add(self, lines: DataFrame) -> None:
        """Take in a batch (doc_id, key; one row for each document and key), then compact full levels.

        The batch is combined before its only shuffle and merged with each run where that run's buckets lie;
        rows that no run answers are the anti-join, and only they get a holder.
        """
        batch = lines.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        for name in self._names():
            known = self.spark.table(name).select("key", F.lit(True).alias("known"))
            batch = batch.hint("merge").join(known, "key", "left").withColumn("last", F.when(F.col("known").isNull(), F.col("last"))).drop("known")
        self._write(batch.select("key", "n_docs", F.col("last").alias("holder")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            self._drop(full)
            level += 1

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """Keys in so many documents, over all runs: (key, n_docs, holder)."""
        return self._merged(self._names()).filter(F.col("n_docs") >= least_docs)

    def close(self) -> None:
        """Remove the runs."""
        self._drop(self._names())
        self.levels = []


def _once(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """One row for each document and key, also for the doc_ids that several rows share."""
    lines = lines.select("doc_id", "key")
    if shared.isEmpty():
        return lines
    return lines.join(shared, "doc_id", "left_anti").unionByName(lines.join(shared, "doc_id", "left_semi").distinct())


def _losses(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, part, keys) of the keys that each text of a document loses.

    A key that makes up a thousandth of all rows joined here goes by broadcast, of which there are a thousand at
    most, so that no task gets all rows of a very common line.
    """
    total = repeated.agg(F.sum("n_docs")).first()[0] or 0
    common = F.col("n_docs") * 1_000 > total
    lines, held = lines.select("doc_id", "part", "key"), repeated.select("key", "holder")
    hot = F.broadcast(held.filter(common)) if total else held.filter(common)
    often = lines.join(hot, "key")
    rest = lines.join(hot, "key", "left_anti").join(held.filter(~common), "key")
    lost = often.unionByName(rest).filter("doc_id <> holder")
    return lost.groupBy("doc_id", "part").agg(F.collect_list("key").alias("keys"))


def deduplicate(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """Texts without the lines that other documents have too: (doc_id, n_lines, n_dropped, kept_text).

    docs: doc_id, text; other columns are not read. A line's key is the line stripped of ASCII white space
    with A-Z lower-cased. Keys of least_chars code points in least_docs documents lose their lines everywhere but in the
    largest doc_id holding them, which keeps all of them. Documents go through the runs in batches of
    falling doc_id, so the batch that sees a key first has its holder.

    Null and empty texts are one empty line. Rows of one doc_id are one document for the counts and each
    treated alike; rows without doc_id count as one document before all others. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("given"), "text")
    docs = given.select("given", F.coalesce("given", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("part"), "text")
    shared = materialize(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = sum((F.col("doc_id") < c).cast("int") for c in cuts) if cuts else F.lit(0)
    path = scratch_path(spark)
    line_keys(docs, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, part long, key binary, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for i in range(len(cuts) + 1):
        runs.add(_once(lines.filter(F.col("batch") == i), shared))
    repeated = materialize(runs.repeated(least_docs))
    runs.close()
    losses = _losses(lines, repeated)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(rows):
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                all_lines = raw.split(b"\n")
                if keys:
                    gone = set(keys)
                    stay = [x for x, k in zip(all_lines, keyed_lines(raw, least_chars), strict=True) if k not in gone]
                else:
                    stay = all_lines
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(stay))
                kept.append(b"\n".join(stay) if keys else raw)
            columns = [part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return docs.join(losses, ["doc_id", "part"], "left").select("given", "text", "keys").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and the hash of the kept text."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
