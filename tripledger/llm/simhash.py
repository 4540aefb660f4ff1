"""SimHash fingerprints, and search within a Hamming radius by permuted block tables.

Words and word pairs vote with the root of their number on the 64 bits of their hashes. Fingerprints are cut into five
blocks, and each block in turn is the key of a table. Of two within 9 bits, some block differs in one bit at most: a query looks
under its own block and under those one bit away, so the five tables hold every such pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm.arrow_rows import slices

BITS = 64
RADIUS, BLOCKS = 3, 5
#: Within this many bits lie 96 % of the pairs of different texts on sf0.1 whose 5-word shingles agree to 0.75 or more; within RADIUS, 19 %.
REACH = 9
PAIRS = "fingerprint long, found long, distance int, n long"
SALTS = 8
_U = np.uint64
_WORDS: dict[bytes, int] = {}


def _words(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    found = list(map(_WORDS.get, words))
    if None in found:
        if len(_WORDS) > 300_000:
            _WORDS.clear()
        found = [_WORDS.setdefault(w, xxhash.xxh3_64_intdigest(w)) if x is None else x for w, x in zip(words, found, strict=True)]
    return np.array(found, _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(27))


def fingerprint(text: str) -> int:
    """64 bits by weighted votes of words and word pairs; 0 for a text without words."""
    words = _words(text)
    if not len(words):
        return 0
    terms = np.concatenate([words, _mix(words[:-1] * _U(3) + _mix(words[1:]))])
    terms, n = np.unique(terms, return_counts=True)
    votes = np.unpackbits(terms.astype(">u8").view(np.uint8)).reshape(-1, BITS).astype(np.float32)
    weight = np.sqrt(n).astype(np.float32)
    return int.from_bytes(np.packbits(2 * (weight @ votes) > weight.sum()).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many code points from the start of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc: int | None, text: str, print_: int, following: str, print_next: int) -> tuple:
    new = edited(text, following)
    print_new = fingerprint(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), sha, f"{print_:016x}", f"{print_new:016x}", likeness(print_, print_new), likeness(print_, print_next)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the next document's, and of its edited text: the columns of COLUMNS.

    docs: doc_id, text; other columns are not read. Null texts count as empty. The order is by doc_id (null first), among rows of one
    doc_id by a hash of the text; after the last document comes the first. A single row is its own next. An empty table
    gives an empty one.

    Ranges of doc_id are sorted and walked once; only the first and last text of each range meet those of its
    neighbours in a join.
    """
    rim = COLUMNS + ", part int, text string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        part = None
        for batch in slices(batches):
            rows = []
            for doc, text, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                print_ = fingerprint(text) if last is None or text != last[1] else last[2]
                if last is None:
                    rows.append((doc, None, "head", *[None] * 4, part, text))
                else:
                    rows.append((*_row(*last, text, print_), part, None))
                last = (doc, text, print_)
            yield _table(rows, rim)
        if last is not None:
            yield _table([(last[0], None, "tail", *[None] * 4, part, last[1])], rim)

    tie = F.xxhash64("text")
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    walked = materialize(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(walk, rim))
    done = walked.filter("n_chars is not null").drop("part", "text")
    heads = walked.filter("n_chars is null and edited_sha256 = 'head'").select("part", F.col("text").alias("following"))
    tails = walked.filter("n_chars is null and edited_sha256 = 'tail'").select("doc_id", "text", "part")
    # one number for each range
    order = heads.select("part").withColumn("to", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())))
    met = tails.join(order, "part").join(heads.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_row(d, t, fingerprint(t), f, fingerprint(f)) for d, t, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield _table(rows, COLUMNS)

    return done.unionByName(met.mapInArrow(close, COLUMNS))


_CUTS = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
_MASKS = [((1 << (b - a)) - 1) << a for a, b in zip(_CUTS, _CUTS[1:], strict=False)]


def _dealt(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(k, n, fingerprint) by key of a table, sorted: queries (n = 0) before the distinct fingerprints and the number of their rows.

    Queries of a key come first, so the rows stream past them in batches. Rows of one key are dealt over SALTS parts.
    """
    flips = radius // BLOCKS  # some block differs in no more bits
    probes = [(t, sum(1 << x for x in bits)) for t, (a, b) in enumerate(zip(_CUTS, _CUTS[1:], strict=False)) for n in range(flips + 1) for bits in combinations(range(a, b), n)]

    def key(print_: Column, table: int, salt: Column) -> Column:
        block = F.shiftrightunsigned(print_, _CUTS[table]).bitwiseAND(F.lit((1 << (_CUTS[table + 1] - _CUTS[table])) - 1))
        return ((block * BLOCKS + table) * SALTS + salt).cast("int")

    rows = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    keys = F.array(*(key(F.col("fingerprint"), t, F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS))) for t in range(BLOCKS)))
    rows = rows.select(F.explode(keys).alias("k"), "n", "fingerprint")
    probe = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(_signed(flip)).cast("long").alias("flip")) for t, flip in probes))).alias("p")
    asked = queries.filter("fingerprint is not null").select("fingerprint").distinct().select("fingerprint", probe)
    flipped = F.col("fingerprint").bitwiseXOR(F.col("p.flip"))
    start = F.get(F.array(*(key(flipped, t, F.lit(0)) for t in range(BLOCKS))), F.col("p.t"))
    asked = asked.select(F.explode(F.sequence(start, start + SALTS - 1)).alias("k"), F.lit(0).cast("long").alias("n"), "fingerprint")
    return asked.unionByName(rows).repartition("k").sortWithinPartitions("k", "n")


def _meetings(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(queries, found, distance, rows) of all that meet in the first table that holds them, in blocks; None ends a key."""
    flips = radius // BLOCKS
    now = None
    asking: list[np.ndarray] = []
    for batch in batches:
        k, n, print_ = (batch.column(i).to_numpy() for i in range(3))
        if not len(k):
            continue
        edge = np.flatnonzero(np.r_[True, np.diff(k) != 0])
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(k)], strict=True):
            if k[a] != now:
                now, asking = k[a], []
            split = a + int(np.searchsorted(n[a:b], 1))
            if split > a:
                asking.append(print_[a:split].copy())
            if not asking or split == b:
                continue
            table = int(now) // SALTS % BLOCKS
            asking = [np.concatenate(asking)]
            for of in range(0, len(asking[0]), 512):
                q = asking[0][of : of + 512]
                for at in range(split, b, 4_096):
                    x = print_[at : min(at + 4_096, b)]
                    i, j = np.nonzero(np.bitwise_count(q.view(_U)[:, None] ^ x.view(_U)[None]) <= radius)
                    differ = (q[i] ^ x[j]).view(_U)
                    first = np.ones(len(i), bool)
                    for m in _MASKS[:table]:
                        first &= np.bitwise_count(differ & _U(m)) > flips
                    if first.any():
                        i, j, differ = i[first], j[first], differ[first]
                        yield q[i], x[j], np.bitwise_count(differ).astype(np.int32), n[at : at + 4_096][j]


def pairs(prints: DataFrame, queries: DataFrame, radius: int = REACH) -> DataFrame:
    """(fingerprint, found, distance, n): every distinct fingerprint of prints within radius of each distinct one of queries, and
    how many rows of prints have it. The rows of a document are those of its fingerprint.

    Both hold a column fingerprint long; equal ones are counted together first; null ones are not asked for, and empty tables
    give no pairs. A group of m near copies of which q are asked for has q x m pairs; ``found`` counts them without giving them out.
    """
    names = [f.split()[0] for f in PAIRS.split(", ")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _meetings(batches, radius):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return _dealt(prints, queries, radius).mapInArrow(meet, PAIRS)


FOUND = "fingerprint long, n_near long, n_found long, least long"


def found(prints: DataFrame, queries: DataFrame, near: int = RADIUS, radius: int = REACH) -> DataFrame:
    """(fingerprint, n_near, n_found, least): for each distinct fingerprint of queries, how many rows of prints are within near and
    within radius, and the least fingerprint (as a signed number) within radius, the class of all that share it.

    The pairs are counted where they meet, so what leaves a task is one row a query and batch of pairs. Null fingerprints are
    not asked for; queries that meet none give no row.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def counted() -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 4
            asked, at = np.unique(parts[0], return_inverse=True)
            n_near, n_found = (np.bincount(at, w, len(asked)).astype(np.int64) for w in (np.where(parts[2] <= near, parts[3], 0), parts[3]))
            least = np.full(len(asked), np.iinfo(np.int64).max)
            np.minimum.at(least, at, parts[1])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (asked, n_near, n_found, least)], [f.split()[0] for f in FOUND.split(", ")])

        for columns in _meetings(batches, radius):
            held.append(columns)
            size += len(columns[0])
            if size > 500_000:
                yield counted()
                held.clear()
                size = 0
        yield counted()

    met = _dealt(prints, queries, radius).mapInArrow(meet, FOUND)
    return met.groupBy("fingerprint").agg(F.sum("n_near").alias("n_near"), F.sum("n_found").alias("n_found"), F.min("least").alias("least"))


def neighbours(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(fingerprint, n_near): how many rows of prints lie within RADIUS of each distinct fingerprint of queries."""
    return pairs(prints, queries, RADIUS).groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search(docs: DataFrame, every: int = 20) -> DataFrame:
    """with_next(docs), and for each document whose doc_id is divisible by every: how many rows (itself included) have a fingerprint
    within RADIUS (n_near) and within REACH (n_found) of its own, and its class, the least fingerprint within REACH. Null for the
    others and for rows without doc_id.

    Null and empty texts have fingerprint 0 and find each other; every repeated row is found as a row of its own; an empty table
    gives an empty one.
    """
    number = F.conv("fingerprint", 16, -10).cast("long")
    rows = materialize(with_next(docs))
    prints = rows.select("doc_id", number.alias("fingerprint"))
    met = found(prints, prints.filter(F.col("doc_id") % every == 0)).withColumn("class", F.lower(F.lpad(F.hex("least"), 16, "0"))).drop("least")
    asked = rows.filter(F.col("doc_id") % every == 0).withColumn("p", number).join(met.withColumnRenamed("fingerprint", "p"), "p", "left").drop("p")
    return asked.unionByName(rows.filter(F.coalesce(F.col("doc_id") % every != 0, F.lit(True))), allowMissingColumns=True)
