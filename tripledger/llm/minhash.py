"""Near copies: banded MinHash, odd sketches for the candidates, and full shingle sets to confirm them.

The MinHash samples of a document are also folded into an odd sketch: each sample flips one bit, so the XOR
of two sketches shows how many samples differ, precisely where that is few. Candidates of the bands are
compared by sketch first; only those that may reach the threshold have their full texts compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm.arrow_rows import map_rows, slices

SHINGLE = 5
BANDS, ROWS_PER_BAND = 40, 5
SKETCH_BITS = 512
_U = np.uint64
_WORDS: dict[bytes, int] = {}
_WORDS_KEPT = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, 2 * BANDS * ROWS_PER_BAND + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[: BANDS * ROWS_PER_BAND] | _U(1), _SEEDS[BANDS * ROWS_PER_BAND :]


def _word(word: bytes) -> int:
    if len(_WORDS) > _WORDS_KEPT:
        _WORDS.clear()
    return _WORDS.setdefault(word, xxhash.xxh3_64_intdigest(word))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the distinct 5-word shingles, ascending; with fewer words, of the whole sequence; else none.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    found = list(map(_WORDS.get, words))
    if None in found:
        found = [_word(w) if x is None else x for w, x in zip(words, found, strict=True)]
    h = np.array(found, _U)
    size = min(SHINGLE, len(h))
    total = np.zeros(len(h) - size + 1, _U)
    for k in range(size):
        total = _mix(total + h[k : len(h) - size + 1 + k])
    return np.unique(total + _U(size))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples (32 bits each) of one non-empty set."""
    low = np.full(len(_TIMES), np.iinfo(np.uint64).max, _U)
    for at in range(0, len(hashes), 2_048):
        low = np.minimum(low, (hashes[at : at + 2_048, None] * _TIMES + _PLUS).min(axis=0))
    return low >> _U(32)


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Each sample flips the bit that its number and value choose: 64-bit words."""
    bit = (_mix(mins + (np.arange(len(mins), dtype=_U) << _U(32))) % _U(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(">u8").astype(_U)


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins.reshape(BANDS, ROWS_PER_BAND)
    key = np.arange(BANDS, dtype=_U)
    for k in range(ROWS_PER_BAND):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, sketch array<long>, bands array<long>) of each row; no bands for an empty set."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, sketches, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingles(text)
            n.append(len(own))
            if len(own):
                mins = samples(own)
                keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()))
                sketches.append(odd_sketch(mins).view(np.int64))
                bands.append(band_keys(mins).view(np.int64))
            else:
                keys.append(None)
                sketches.append(np.zeros(0, np.int64))
                bands.append(np.zeros(0, np.int64))
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "sketch", "bands"])

    return map_rows(_hashed(docs), make, "doc_id long, text_hash long, n_shingles long, set_key string, sketch array<long>, bands array<long>")


def sketch_similarity(a: str, b: str) -> Column:
    """Jaccard similarity estimated from two odd sketches: 1 + m / 4k * ln(1 - 2 z / m), z the bits in which they differ."""
    words = range(SKETCH_BITS // 64)
    z = reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in words))
    left = F.greatest(F.lit(1.0) - 2.0 * z / SKETCH_BITS, F.lit(1e-3))
    return 1.0 + SKETCH_BITS / (4.0 * BANDS * ROWS_PER_BAND) * F.log(left)


#: Four standard deviations of the estimate at the threshold stay in.
SKETCH_MARGIN = 0.18
#: Members of a bucket that are compared with each other in one piece.
BLOCK = 2_048


def sketch_bits(similarity: float) -> int:
    """The most bits in which two sketches of at least that estimated similarity differ."""
    return int(SKETCH_BITS * (1 - exp(-4 * BANDS * ROWS_PER_BAND * (1 - similarity) / SKETCH_BITS)) / 2)


def _cells(members: DataFrame) -> DataFrame:
    """Members of each bucket dealt over cells: one for each part of about BLOCK rows, and one for each two parts."""
    parts = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return other.withColumns({"x": low, "y": high, "first": F.col("part") == low}).drop("parts", "part", "other")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition, cell by cell; bucket, x and y are the first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = np.concatenate([np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1) for b in held])
        edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        if len(edge) > 1:
            table = pa.Table.from_batches(held)
            for a, b in zip(edge, edge[1:], strict=False):
                yield table.slice(a, b - a)
            held = table.slice(edge[-1]).combine_chunks().to_batches()  # the last cell may go on
    if held:
        yield pa.Table.from_batches(held)


def _promising(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of the pairs of a cell, node a < node b, of different roots, whose sizes and sketches let them reach the threshold
    and whose first common band is this bucket: so each pair comes up once in all buckets."""
    node, root, size, mine = (cell[c].to_numpy(zero_copy_only=False) for c in ("node", "root", "n_shingles", "first"))
    sketch, bands = (np.stack(cell[c].to_numpy(zero_copy_only=False)) for c in ("sketch", "bands"))
    sketch, bucket, most = sketch.view(_U), cell["bucket"][0].as_py(), sketch_bits(percent / 100 - SKETCH_MARGIN)
    found_a, found_b = [], []
    for at in range(0, len(node), 512):
        here = slice(at, at + 512)
        ok = (root[here, None] != root[None, :]) & (node[here, None] < node[None, :])
        if not mine.all():
            ok &= mine[here, None] != mine[None, :]
        ok &= 100 * np.minimum(size[here, None], size[None, :]) >= percent * np.maximum(size[here, None], size[None, :])
        i, j = np.nonzero(ok)
        for cut in range(0, len(i), 50_000):
            x, y = at + i[cut : cut + 50_000], j[cut : cut + 50_000]
            near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1) <= most
            x, y = x[near], y[near]
            same = bands[x] == bands[y]
            first = bands[x, same.argmax(axis=1)] == bucket
            found_a.append(x[first])
            found_b.append(y[first])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def links_apart(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different root in one bucket, enough of them to join all roots that any pair links.

    members: bucket, node, root, n_shingles, sketch, bands; texts: node, text. Pairs are made and confirmed on the full sets inside a
    task, cell by cell; rows that travel are members, never pairs. The first pass keeps the members that have a promising
    pair; only these bring their text to the second.
    """

    def busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            rows = np.unique(np.concatenate(_promising(cell, percent)))
            if len(rows):
                yield cell.select(["bucket", "node"]).take(pa.array(rows)).combine_chunks().to_batches()[0]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            a, b = _promising(cell, percent)
            sets = [shingles(t) for t in cell["text"].to_pylist()] if len(a) else []
            node, top = cell["node"].to_pylist(), {r: r for r in cell["root"].to_pylist()}

            def find(x: int, top: dict[int, int] = top) -> int:
                while top[x] != x:
                    x = top[x]
                return x

            root, found = cell["root"].to_pylist(), []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                ri, rj = find(root[i]), find(root[j])
                if ri == rj:
                    continue
                one, two = sets[i], sets[j]
                at = np.searchsorted(two, one)
                both = int((two[np.minimum(at, len(two) - 1)] == one).sum())
                if 100 * both >= percent * (len(one) + len(two) - both):
                    top[ri] = rj
                    found.append((node[i], node[j]))
            columns = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [(), ()])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def sort(cells: DataFrame) -> DataFrame:
        return cells.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    keys = ["bucket", "x", "y", "node", "root", "n_shingles", "first", "sketch", "bands"]
    kept = sort(_cells(members).select(keys)).mapInArrow(busy, "bucket long, node long").distinct()
    close = materialize(members.join(kept, ["bucket", "node"], "left_semi"))
    return sort(_cells(close.join(texts, "node")).select(*keys, "text")).mapInArrow(confirm, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: node, text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, _U))
        for batch in slices(batches, 2, 16_000_000):
            good = []
            for b, one, two in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if last[0] != b:
                    last = (b, shingles(two))
                own = shingles(one)
                both = len(own) + len(last[1]) - len(np.union1d(own, last[1]))
                good.append(100 * both >= percent * (len(own) + len(last[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    with_both = with_one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
    return with_both.select("a", "b", "one", "two").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, itself included.

    Alternates two steps until nothing changes: every node ties its larger neighbours to its smallest
    neighbour, then its smaller ones and itself. Each is a minimum (combined before the shuffle) joined back, so a node with
    very many neighbours is never gathered; the number of rounds grows with the logarithm of the longest path.
    """

    def stars(links: DataFrame, larger: bool) -> DataFrame:
        both = links if not larger else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = both.join(low, "u")
        out = tied.filter("v > u") if larger else tied.filter("v < u")
        moved = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (moved if larger else moved.unionByName(low.select("u", F.col("m").alias("v")))).filter("u > v").distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while (now := state(links)) != before:
        before = now
        links = materialize(stars(materialize(stars(links, True)), False))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Groups of near copies: (doc_id, n_shingles, component_id, kept) of each row of docs.

    docs: doc_id, text; other columns are not read. Documents are linked from percent / 100 Jaccard similarity of
    their 5-word shingle sets on. Null, empty and blank texts have empty sets and are linked with nothing. Rows with the same doc_id count as
    one document. A row without doc_id has no component and is kept. An empty table gives an empty one.

    Equal sets are one node, so copies are never paired. Within a bucket of a band, members are compared with its
    smallest node first and then, as far as they are not connected yet, with its largest; what is still
    apart after that is compared in full. So a group of copies costs links in proportion to its size.
    A pair at the threshold shares no band with probability 2e-5, and its sketches lie further apart than the margin with 3e-5.
    """
    signed = materialize(signatures(docs.select("doc_id", "text")))
    known = signed.filter("doc_id is not null and set_key is not null")
    sets = known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("sketch", "bands", "n_shingles", "text_hash"), "doc_id").alias("x"))
    nodes = materialize(sets.select("set_key", "node", "x.*"))
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = materialize(exploded.join(shared, "bucket").select("bucket", "node", "low", "high"))

    # one document may hold several sets: of its own rows, or by a copy
    same_doc = known.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y")
    repeated = known.join(same_doc.select("doc_id"), "doc_id").select("doc_id", "set_key").distinct()
    own = repeated.join(nodes.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    busy = members.select("node").distinct()
    texts = _hashed(docs).withColumnRenamed("doc_id", "node").join(nodes.join(busy, "node").select("node", "text_hash"), ["node", "text_hash"])
    texts = materialize(texts.select("node", "text").dropDuplicates(["node"]))
    sketches = nodes.select("node", "sketch", "n_shingles")

    def promising(pairs: DataFrame) -> DataFrame:
        one = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
        two = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
        sized = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (sketch_similarity("sa", "sb") >= percent / 100 - SKETCH_MARGIN)
        return pairs.join(one, "a").join(two, "b").filter(sized).select("a", "b")

    def toward(hub: str, rows: DataFrame) -> DataFrame:
        """For each member one hub, the one it shares most bands with."""
        met = rows.filter(F.col("node") != F.col(hub)).groupBy("node", hub).agg(F.count("*").alias("n"))
        return met.groupBy("node").agg(F.max_by(hub, F.struct("n", hub)).alias("b")).select(F.col("node").alias("a"), "b")

    edges = materialize(confirmed(promising(toward("low", members)), texts, percent).unionByName(own))
    root = components(edges)
    apart = materialize(_apart(members, root))
    edges = materialize(edges.unionByName(confirmed(promising(toward("high", apart)), texts, percent)))
    root = components(edges)
    apart = materialize(_apart(members, root))
    described = apart.join(nodes.select("node", "n_shingles", "sketch", "bands"), "node").select("bucket", "node", "root", "n_shingles", "sketch", "bands")
    edges = edges.unionByName(links_apart(described, texts, percent))
    root = materialize(components(edges))

    placed = nodes.select("set_key", "node").join(root, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _apart(members: DataFrame, root: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components: (bucket, node, high, root)."""
    placed = members.join(root, "node", "left").select("bucket", "node", "high", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("bucket")
    return placed.join(split, "bucket")
