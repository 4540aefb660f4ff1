"""Statement files to cell rows (SRC1-SRC5, SRC10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED_SUFFIXES = ["csv", "pdf", "xls", "xlsx"]  # fixed values
DELIMITERS = [",", ";", "\t"]
SNIFF_LINES = 40

STANDARD_SCHEMA = (
    "transaction_date string, description string, purchase_amount string, purchase_currency string, cad_amount string, "
    "transaction_type string, posted_date string, account string, cardholder string, category string"
)


#: Bytes of a file that a task hashes as one value. A value holds 2 GB at most, and an executor several copies of it.
HASHED_WHOLE = 256 << 20


def _file_rows(files: DataFrame, sha256: Column | None = None) -> DataFrame:
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.filter(~name.startswith(".")).select(
        F.element_at(parts, -2).alias("trip_id"),
        name.alias("source_file"),
        F.col("length").alias("size"),
        (F.sha2("content", 256) if sha256 is None else sha256).alias("sha256"),
        suffix.isin(SUPPORTED_SUFFIXES).alias("supported"),
        "content",
        F.col("modificationTime").alias("modified_at"),
        "path",
    )


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists each of up to 10,000 paths in a task of its own, which takes longer to start than to run."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _stream_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, read block by block through Spark's file system client."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def scan_files(spark: SparkSession, root: str, glob: str = "*", depth: str = "*/", hashed: bool = True) -> DataFrame:
    """SRC1: trip folders to (trip_id, source_file, size, content, sha256, supported, path); dot files skipped.

    Content is read only where content or hash is selected. Files over HASHED_WHOLE are hashed here, block by block; a hash
    is a chain over the file, so no tasks can share one. hashed: false where no hash is selected, which leaves that out.
    """
    with _few_listing_tasks(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root.rstrip('/')}/{depth}")
    large = F.col("length") > HASHED_WHOLE
    paths = [r.path for r in _file_rows(files.filter(large)).select("path").collect()] if hashed else []
    if not paths:
        return _file_rows(files)
    with ThreadPoolExecutor(4) as pool:
        hashes = dict(zip(paths, pool.map(lambda path: _stream_sha256(spark, path), paths), strict=True))
    known = F.create_map(*[F.lit(x) for pair in hashes.items() for x in pair])
    return _file_rows(files.filter(~large)).unionByName(_file_rows(files.filter(large), F.try_element_at(known, F.col("path"))))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC1 for named files, whose names may hold any letter; one that has gone since it was listed gives no row."""
    literal = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    with _few_listing_tasks(spark):
        return _file_rows(spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(literal))


# The windows-1252 block 0x80-0x9F, which differs from ISO-8859-1 (fixed values; unassigned bytes stay)
_BLOCK = "".join(chr(c) for c in range(0x80, 0xA0))
_CP1252 = "".join(
    bytes([c]).decode("cp1252") if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(c) for c in range(0x80, 0xA0)
)


def decode_bytes(content: Column) -> tuple[Column, Column]:
    """SRC2: (text, encoding). UTF-16 mark, UTF-8 mark, zero bytes near the start, UTF-8, else cp1252."""
    head = F.hex(F.substring(content, 1, 200))
    utf16 = head.startswith("FFFE") | head.startswith("FEFF")
    bom8 = head.startswith("EFBBBF")
    zero = head.rlike("^(?:..)*?00")
    valid8 = F.call_function("is_valid_utf8", content.cast("string"))
    latin = F.translate(F.decode(content, "ISO-8859-1"), _BLOCK, _CP1252)
    skip = lambda n: F.substring(content, n + 1, 2147483647)
    text = (
        F.when(head.startswith("FFFE"), F.decode(skip(2), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(skip(2), "UTF-16BE"))
        .when(bom8, skip(3).cast("string"))
        .when(zero, F.decode(content, "UTF-16LE"))
        .when(valid8, content.cast("string"))
        .otherwise(latin)
    )
    encoding = (
        F.when(utf16 | (zero & ~bom8), F.lit("utf-16"))
        .when(bom8, F.lit("utf-8-sig"))
        .when(valid8, F.lit("utf-8"))
        .otherwise(F.lit("cp1252"))
    )
    return text, encoding


# A record ends at a line break outside its quoted cells; a quote elsewhere than around a whole cell is a plain letter.
_CELL = r'(?:"(?:[^"]|"")*+"(?=[,;\t\r\n]|\z)|[^,;\t\r\n]*+)'
RECORD = rf"(?:(?<![\s\S])|(?<=[\r\n])){_CELL}(?:[,;\t]{_CELL})*+(?:\r\n|\n|\r|\z)"


def records(text: Column) -> Column:
    """The records of a delimited text in order; cells in quotes may hold line breaks."""
    return F.transform(F.regexp_extract_all(text, F.lit(RECORD), F.lit(0)), lambda r: F.regexp_replace(r, r"(?:\r\n|\n|\r)\z", ""))


def file_lines(files: DataFrame) -> DataFrame:
    """(trip_id, source_file, row_no, line) of decoded csv files, one row for each record; row_no starts at 1."""
    text, encoding = decode_bytes(F.col("content"))
    return files.filter("supported").select(
        "trip_id", "source_file", encoding.alias("encoding"), F.posexplode(records(text)).alias("_p", "line")
    ).select("trip_id", "source_file", "encoding", (F.col("_p") + 1).cast("bigint").alias("row_no"), "line")


def _cells(line: Column, sep: str) -> Column:
    """The cells of a record: each starts behind a delimiter, and quotes count only around a whole cell. Linear in the record."""
    pattern = rf'(?:(?<![\s\S])|(?<={sep}))(?:"(?:[^"]|"")*+"(?={sep}|\z)|[^{sep}]*+)'
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def _bare(sep: str) -> Column:
    """The line without the quotes around it when the whole row is one quoted cell."""
    line = F.col("line")
    whole = (F.length(line) > 1) & line.rlike(r'^"[^"]*"$')
    return line if sep == "," else F.when(whole, F.expr("substring(line, 2, length(line) - 2)")).otherwise(line)


def detect_delimiter(lines: DataFrame) -> DataFrame:
    """SRC3: per file the delimiter whose row width is most consistent over its first lines.

    Only the first 40 lines of a file are looked at, three small rows each.
    """
    head = lines.filter((F.col("row_no") <= SNIFF_LINES) & (F.trim("line") != ""))
    widths = head.select(
        "trip_id",
        "source_file",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("choice"),
                        F.lit(sep).alias("delimiter"),
                        F.size(_cells(_bare(sep), sep)).alias("width"),
                    )
                    for i, sep in enumerate(DELIMITERS)
                ]
            )
        ).alias("w"),
    ).select("trip_id", "source_file", "w.*")
    counted = widths.groupBy("trip_id", "source_file", "choice", "delimiter", "width").agg(F.count("*").alias("n"))
    common = counted.groupBy("trip_id", "source_file", "choice", "delimiter").agg(
        F.max(F.struct("n", "width")).alias("c")
    )
    score = F.struct(
        F.when(F.col("c.width") > 1, F.col("c.n")).otherwise(F.lit(0)).alias("same"),
        F.col("c.width").alias("width"),
        (-F.col("choice")).alias("order"),
    )
    return common.groupBy("trip_id", "source_file").agg(F.max_by("delimiter", score).alias("delimiter"))


def split_cells(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """SRC4: (trip_id, source_file, row_no, cells); rows quoted as a whole are unwrapped first."""
    joined = lines.join(delimiters, ["trip_id", "source_file"])
    line = F.col("line")
    inner = F.regexp_replace(F.expr("substring(line, 2, length(line) - 2)"), '""', '"')
    alone = F.size(_cells(line, ",")) == 1
    wrapped = (
        (F.col("delimiter") != ",") & (F.length(line) > 1) & line.startswith('"') & line.endswith('"') & alone
        & inner.contains(F.col("delimiter"))
    )
    plain = F.when(wrapped, inner).otherwise(line)
    cells = F.coalesce(
        *[F.when(F.col("delimiter") == sep, _cells(plain, sep)) for sep in DELIMITERS]
    )
    unquoted = F.transform(
        cells,
        lambda c: F.when(
            (F.length(c) > 1) & c.startswith('"') & c.endswith('"'),
            F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), '""', '"'),
        ).otherwise(c),
    )
    return joined.select("trip_id", "source_file", "row_no", unquoted.alias("cells"))


def read_standard_statements(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the documented ten-column template, columns by header name."""
    return (
        spark.read.option("header", True).schema(STANDARD_SCHEMA).option("enforceSchema", False).csv(path)
    )


def duplicate_files(files: DataFrame) -> DataFrame:
    """SRC10: later files of a folder with the same size and content are marked.

    The first file per content is an aggregate joined back, so copies never gather in one task.
    """
    keys = ["trip_id", "kind", "size", "sha256"]
    first = files.groupBy(*keys).agg(F.min("source_file").alias("first_file"))
    return files.join(first, keys).withColumn("is_duplicate", F.col("source_file") != F.col("first_file"))
