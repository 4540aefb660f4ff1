"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

A shard holds the posting lists of the documents of one task, in blocks of 128 postings. Each block has its
last document, its packed postings and, for four classes of term frequency, the largest frequency
and the shortest document, from which its largest score follows without unpacking. Lists of terms with one hash
share a row of the index.

A query's lists are sorted by their largest score. The lists whose bounds together stay under the
threshold (the k-th best score so far) are non-essential: only the others give candidates, and a candidate looks
up non-essential lists block by block, after the bounds of its blocks have shown that it can still be
among the best. The heaps of the shards are merged by two ranked steps.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm.arrow_rows import slices

#: Postings in a block, text bytes in a shard, rows of the index in a shard.
BLOCK, SHARD_BYTES, BUCKETS = 128, 32 << 20, 256
#: Items searched together, and documents between two looks at the threshold.
ITEMS, WINDOW = 256, 2_048
#: Shards whose rows of one bucket are joined in one task, and parts of the first merge of heaps.
SHARDS_TOGETHER, MERGE_PARTS = 256, 64
TOP = 50
#: The bucket of the row that holds a shard's documents.
DOCUMENTS = -1
INDEX = (
    "shard long, bucket int, n_docs long, n_terms long, doc_ids array<long>, lengths array<int>, "
    "terms binary, dfs binary, lasts binary, widths binary, bounds binary, postings binary"
)
# Terms are runs of ASCII letters, digits and all other characters; A-Z are lower-cased.
_TO_TERMS = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8").translate(_TO_TERMS).split() if text else []


def _cut(raw: np.ndarray, at: np.ndarray) -> pa.BinaryArray:
    """One buffer as binary values between the given byte positions."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _width(largest: np.ndarray) -> np.ndarray:
    """Bytes that hold the largest value: 1, 2 or 4."""
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def _pack(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Little-endian values of the given widths into out."""
    for b in range(4):
        some = width > b
        out[at[some] + b] = (values[some] >> (8 * b)) & 255


class _Shard:
    """Postings of a shard under construction."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.bytes = 0
        self._ids: list[np.ndarray] = []
        self._tfs: list[np.ndarray] = []
        self._sizes: list[int] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        counts = Counter(terms_of(text))
        self.doc_ids.append(doc_id)
        self.lengths.append(counts.total())
        self.bytes += len(text or "") + 64
        self._sizes.append(len(counts))
        self._ids.append(np.fromiter(map(self.vocabulary.__getitem__, counts), np.int32, len(counts)))
        self._tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's row of documents and its rows of posting lists."""
        schema = pa.schema([
            ("shard", pa.int64()), ("bucket", pa.int32()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("terms", "dfs", "lasts", "widths", "bounds", "postings")),
        ])
        # documents of equal scores go by doc_id, those without one last: that is their order in the shard
        order = sorted(range(len(self.doc_ids)), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        lengths = np.array(self.lengths, np.int32)[order]
        head = {
            "shard": shard, "bucket": DOCUMENTS, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum(dtype=np.int64)),
            "doc_ids": [self.doc_ids[i] for i in order], "lengths": lengths.tolist(),
        }
        yield pa.RecordBatch.from_pylist([head], schema)
        if not self.vocabulary:
            return

        words = list(self.vocabulary)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[by_bucket] = np.arange(len(words), dtype=np.int32)
        term = rank[np.concatenate(self._ids)]
        doc = np.repeat(place, self._sizes)
        tf = np.concatenate(self._tfs)
        order = np.argsort(term.astype(np.int64) << 32 | doc)
        term, doc, tf = term[order], doc[order], tf[order]

        df = np.bincount(term, minlength=len(words))
        first = np.cumsum(df) - df
        inside = np.arange(len(term)) - first[term]
        starts_block = inside % BLOCK == 0
        block = np.cumsum(starts_block) - 1
        block_at = np.flatnonzero(starts_block)
        gap = np.empty(len(doc), np.int64)
        gap[0] = doc[0]
        gap[1:] = doc[1:].astype(np.int64) - doc[:-1]
        gap[first] = doc[first]
        gap_width = _width(np.maximum.reduceat(gap, block_at))
        tf_width = _width(np.maximum.reduceat(tf, block_at))
        count = np.diff(np.r_[block_at, len(doc)])
        size = count * (gap_width + tf_width)
        block_end = np.cumsum(size)
        postings = np.zeros(int(block_end[-1]), np.uint8)
        step = inside % BLOCK
        base = (block_end - size)[block]
        _pack(gap, base + step * gap_width[block], gap_width[block], postings)
        _pack(tf, base + (count * gap_width)[block] + step * tf_width[block], tf_width[block], postings)
        last = doc[block_at + count - 1].astype("<i4")
        bounds = np.zeros((len(count), 4, 2), "<i4")
        bounds[:, :, 1] = np.iinfo(np.int32).max
        kind = np.minimum(tf, 4) - 1
        np.maximum.at(bounds[:, :, 0], (block, kind), tf)
        np.minimum.at(bounds[:, :, 1], (block, kind), lengths[doc])

        words = [words[i] for i in by_bucket]
        used, bucket_first = np.unique(bucket[by_bucket], return_index=True)
        term_cut = np.r_[bucket_first, len(words)]
        word_end = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
        block_of_term = np.r_[block[first], len(count)]
        block_cut = block_of_term[term_cut]
        byte_cut = np.r_[0, block_end][block_cut]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(used), shard)), pa.array(used.astype(np.int32)), none, none,
                pa.nulls(len(used), pa.list_(pa.int64())), pa.nulls(len(used), pa.list_(pa.int32())),
                _cut(np.frombuffer(b" ".join(words) + b" ", np.uint8), word_end[term_cut]), _cut(df.astype("<i4").view(np.uint8), term_cut * 4),
                _cut(last.view(np.uint8), block_cut * 4), _cut((gap_width << 4 | tf_width).astype(np.uint8), block_cut),
                _cut(bounds.reshape(-1).view(np.uint8), block_cut * 32), _cut(postings, byte_cut),
            ],
            schema=schema,
        )


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs (doc_id, text; other columns are not read), to be written before it is searched.

    A null, empty or termless text is a document without terms. Every row is a document of its own, also rows of
    one doc_id and rows without one. An empty table gives an empty index. A shard ends at shard_bytes of text;
    texts are not cut, so a longer one makes a longer shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 33, _Shard()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.doc_ids:
            yield from shard.rows(number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def query_terms(items: DataFrame, together: int) -> DataFrame:
    """The different terms of the items, in blocks of items: (query_block, bucket, term, items).

    items: item_id, text; rows of one item_id are one item, rows without item_id too. A null text has no terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows], pa.int64()), pa.array([zlib.crc32(t) % BUCKETS for _, t in rows], pa.int32()),
                    pa.array([t for _, t in rows], pa.binary()),
                ],
                ["item_id", "bucket", "term"],
            )

    blocks = max(1, -(-items.select("item_id").distinct().count() // together))
    terms = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, bucket int, term binary")
    terms = terms.withColumn("query_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    return terms.groupBy("query_block", "bucket", "term").agg(F.collect_set(F.struct("item_id")).alias("items"))


def _wanted(weighted: DataFrame, salts: int) -> DataFrame:
    """One row for each query block, bucket and salt with its terms, and one for the documents."""
    rows = weighted.groupBy("query_block", "bucket").agg(F.collect_list(F.struct("term", "weight", "items")).alias("wanted"))
    heads = rows.select("query_block").distinct().select("query_block", F.lit(DOCUMENTS).alias("bucket"), F.lit(None).cast(rows.schema["wanted"].dataType).alias("wanted"))
    return rows.unionByName(heads).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shard's document frequencies of the wanted terms: (query_block, term, df)."""
    for batch in batches:
        out = []
        for block, terms, dfs, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            asked = set(wanted)
            df = np.frombuffer(dfs, "<i4")
            out += [(block, t, int(df[i])) for i, t in enumerate(terms.split(b" ")) if t in asked]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())],
            ["query_block", "term", "df"],
        )


LISTS = (
    "query_block int, shard long, doc_ids array<long>, lengths array<int>, weight long, items array<struct<item_id:long>>, "
    "df int, lasts binary, widths binary, bounds binary, postings binary"
)
_LISTS = pa.schema([
    ("query_block", pa.int32()), ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("weight", pa.int64()),
    ("items", pa.list_(pa.struct([("item_id", pa.int64())]))), ("df", pa.int32()), *((c, pa.binary()) for c in ("lasts", "widths", "bounds", "postings")),
])


def _block_sizes(dfs: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes of each block of lists of the given lengths."""
    blocks = -(-dfs // BLOCK)
    count = np.full(int(blocks.sum()), BLOCK, np.int64)
    count[np.cumsum(blocks) - 1] = dfs - (blocks - 1) * BLOCK
    return count * ((widths >> 4) + (widths & 15))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of the wanted terms cut out of the rows of the index, blocks still packed; document rows as they are."""
    for batch in batches:
        for row in range(batch.num_rows):
            r = {name: column[row].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if r["bucket"] == DOCUMENTS:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("query_block", "shard", "doc_ids", "lengths")}], _LISTS)
                continue
            asked = {w["term"]: w for w in r["wanted"]}
            hits = [(i, asked[t]) for i, t in enumerate(r["terms"].split(b" ")) if t in asked]
            if not hits:
                continue
            dfs, widths = np.frombuffer(r["dfs"], "<i4").astype(np.int64), np.frombuffer(r["widths"], np.uint8).astype(np.int64)
            block = np.r_[0, np.cumsum(-(-dfs // BLOCK))].tolist()
            byte = np.r_[0, np.cumsum(_block_sizes(dfs, widths))]
            out = []
            for i, w in hits:
                a, b = block[i], block[i + 1]
                out.append({
                    "query_block": r["query_block"], "shard": r["shard"], "weight": w["weight"], "items": w["items"], "df": int(dfs[i]),
                    "lasts": r["lasts"][4 * a : 4 * b], "widths": r["widths"][a:b], "bounds": r["bounds"][32 * a : 32 * b],
                    "postings": r["postings"][byte[a] : byte[b]],
                })
            yield pa.RecordBatch.from_pylist(out, _LISTS)


class _List:
    """A term's postings in a shard: bounds of blocks at hand, blocks unpacked when first asked for."""

    def __init__(self, row: dict, norm: np.ndarray, norm_of: np.ufunc):
        self.weight = row["weight"]
        self.lasts = np.frombuffer(row["lasts"], "<i4")
        self._widths = np.frombuffer(row["widths"], np.uint8).astype(np.int64)
        self._df, self._raw, self._norm = row["df"], row["postings"], norm
        self._ends = np.cumsum(_block_sizes(np.array([self._df]), self._widths))
        tf, shortest = np.frombuffer(row["bounds"], "<i4").reshape(-1, 4, 2).astype(np.int64).transpose(2, 0, 1)
        part = np.where(tf > 0, 1_000_000_000 * tf // np.maximum(1, 1_000 * tf + 20 * norm_of(np.where(tf > 0, shortest, 0))), 0)
        self.bounds = self.weight * part.max(axis=1)
        self.bound = int(self.bounds.max())
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        if b not in self._blocks:
            gap_width, tf_width = int(self._widths[b] >> 4), int(self._widths[b] & 15)
            start, end = int(self._ends[b - 1]) if b else 0, int(self._ends[b])
            count = (end - start) // (gap_width + tf_width)
            docs = np.cumsum(np.frombuffer(self._raw, f"<u{gap_width}", count, start), dtype=np.int64)
            if b:
                docs += int(self.lasts[b - 1])
            tf = np.frombuffer(self._raw, f"<u{tf_width}", count, start + count * gap_width).astype(np.int64)
            self._blocks[b] = docs, self.weight * (1_000_000_000 * tf // (1_000 * tf + 20 * self._norm[docs]))
        return self._blocks[b]

    def add_range(self, low: int, high: int, scores: np.ndarray) -> None:
        """Add the scores of documents in [low, high) to scores, which starts at low."""
        for b in range(int(np.searchsorted(self.lasts, low)), len(self.lasts)):
            docs, own = self.block(b)
            a, z = np.searchsorted(docs, (low, high))
            scores[docs[a:z] - low] += own[a:z]
            if z < len(docs):
                break

    def block_bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that could hold each document, and the largest score in it (0 behind the last block)."""
        at = np.searchsorted(self.lasts, docs)
        return at, np.where(at < len(self.lasts), self.bounds[np.minimum(at, len(self.lasts) - 1)], 0)

    def scores(self, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of ascending documents in their blocks, 0 where the term is not in the document."""
        out = np.zeros(len(docs), np.int64)
        used, starts = np.unique(at, return_index=True)
        for b, i, j in zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(docs)], strict=True):
            if b < len(self.lasts):
                held, own = self.block(b)
                k = np.searchsorted(held, docs[i:j])
                k[k == len(held)] = 0
                out[i:j] = np.where(held[k] == docs[i:j], own[k], 0)
        return out


def best_of_shard(lists: list[_List], n_docs: int, top: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The best documents of a shard for one query: numbers and scores, best first, equal scores by number."""
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: x.bound)
    upto = np.cumsum([x.bound for x in lists])
    best_docs, best, threshold = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for low in range(0, n_docs if lists else 0, window):
        high = min(low + window, n_docs)
        essential = int(np.searchsorted(upto, threshold, side="right"))  # the lists before it can't pass the threshold together
        if essential == len(lists):
            break
        dense = np.zeros(high - low, np.int64)
        for x in lists[essential:]:
            x.add_range(low, high, dense)
        found = np.flatnonzero(dense)
        docs, scores = found + low, dense[found]
        if essential and len(docs):
            bounds = [x.block_bounds(docs) for x in lists[:essential]]
            may_add = np.sum([b for _, b in bounds], axis=0)
            for i in range(essential - 1, -1, -1):
                keep = scores + may_add > threshold
                docs, scores, may_add = docs[keep], scores[keep], may_add[keep]
                bounds = [(a[keep], b[keep]) for a, b in bounds[: i + 1]]
                if not len(docs):
                    break
                at, bound = bounds[i]
                scores = scores + lists[i].scores(docs, at)
                may_add = may_add - bound
        keep = scores > threshold
        best_docs, best = np.r_[best_docs, docs[keep]], np.r_[best, scores[keep]]
        order = np.lexsort((best_docs, -best))[:top]
        best_docs, best = best_docs[order], best[order]
        if len(best) == top:
            threshold = int(best[-1])
    return best_docs, best


def search(index: DataFrame, items: DataFrame, top: int = TOP, together: int = ITEMS, window: int = WINDOW) -> DataFrame:
    """The top best-scoring documents of each item: (item_id, rank, doc_id, score); rank 1 is the best.

    index: a written index. items: item_id, text, searched so many together; window: documents between two looks
    at the threshold. Documents of equal score go by doc_id, those without one
    last. Items without terms, and terms of no document, give nothing, as does an empty index or table of items.
    """
    totals = index.filter(F.col("bucket") == DOCUMENTS).agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    n_docs, n_terms, shards = (x or 0 for x in totals)
    salts = max(1, -(-shards // SHARDS_TOGETHER))
    terms = materialize(query_terms(items, together))
    salted = index.withColumn("salt", F.pmod("shard", F.lit(salts)).cast("int"))
    # document frequencies, from the columns of terms alone
    asked = materialize(
        terms.groupBy("query_block", "bucket").agg(F.collect_list("term").alias("wanted")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    counted = salted.join(asked, ["bucket", "salt"]).select("query_block", "terms", "dfs", "wanted").mapInArrow(_found, "query_block int, term binary, df long")
    dfs = counted.groupBy("query_block", "term").agg(F.sum("df").alias("df"))
    weight = F.floor(1_000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = terms.join(dfs, ["query_block", "term"]).withColumn("weight", weight)
    wanted = materialize(_wanted(weighted, salts))
    lists = salted.join(wanted, ["bucket", "salt"]).select("query_block", "bucket", "shard", "doc_ids", "lengths", "terms", "dfs", "lasts", "widths", "bounds", "postings", "wanted")

    def norm_of(lengths: np.ndarray) -> np.ndarray:
        return 50 + 50 * lengths.astype(np.int64) * n_docs // max(1, n_terms)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["doc_ids"] is not None)
        norm = norm_of(np.array(head["lengths"], np.int64))
        by_item: dict[int | None, list[_List]] = defaultdict(list)
        for r in rows:
            if r["postings"] is not None:
                own = _List(r, norm, norm_of)
                for item in r["items"]:
                    by_item[item["item_id"]].append(own)
        out = [(item, *best_of_shard(own, len(norm), top, window)) for item, own in by_item.items()]
        docs = np.concatenate([d for _, d, _ in out]) if out else np.empty(0, np.int64)
        return pa.table({
            "item_id": pa.array([i for i, d, _ in out for _ in range(len(d))], pa.int64()), "shard": pa.array(np.full(len(docs), head and rows[0]["shard"])),
            "doc_id": pa.array(head["doc_ids"], pa.int64()).take(pa.array(docs)), "score": pa.array(np.concatenate([s for _, _, s in out]) if out else [], pa.int64()),
        })

    heaps = lists.mapInArrow(_lists, LISTS).groupBy("query_block", "shard").applyInArrow(run, "item_id long, shard long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("shard"), F.lit(MERGE_PARTS))
    merged = heaps.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return (
        merged.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
        .filter(F.col("rank") <= top)
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )
