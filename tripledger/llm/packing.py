"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt to islands of bounded size. On each, a population of packings evolves: crossover injects
whole well-filled bins of one parent into the other, drops the bins that hold the same pieces, and puts
displaced pieces back by best fit. Full bins are settled; the pieces of the others are dealt anew for the
next epoch, where each island also gets the elite of a neighbour: the length patterns of its best bins.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm.arrow_rows import map_rows
from tripledger.llm.word_bpe import codec

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
EVOLVED = f"{PIECE}, sequence_id long, offset long, settled boolean, pattern array<int>, island long"
ARROW = [
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_()), ("pattern", pa.list_(pa.int32())), ("island", pa.int64()),
]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of docs (doc_id, text; other columns are not read): the ids and the end id, cut at capacity.

    A null text counts as empty and gives a piece of the end id alone; every repeated row gives its own.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, ids in zip(batch.column(0).to_pylist(), codec(vocabulary).encode_batch(batch.column(1).to_pylist()), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECE)


class Island:
    """One population of packings of the same pieces. A packing is a list of bins, a bin a list of piece numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)

    def fill(self, packed: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, packed))

    def best_fit(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """loose put, in the given order, each into the bin with the least room that takes it, or into a new one."""
        ladder = sorted((room, k) for k, b in enumerate(bins) if (room := self.capacity - self.fill(b)))
        for i in loose:
            size = self.lengths[i]
            at = bisect_left(ladder, (size, -1))
            if at < len(ladder):
                room, k = ladder.pop(at)
                bins[k].append(i)
            else:
                room, k = self.capacity, len(bins)
                bins.append([i])
            if room > size:
                insort(ladder, (room - size, k))
        return bins

    def by_size(self, loose: list[int], noise: float = 0.0) -> list[int]:
        shake = self.random.uniform
        return sorted(loose, key=lambda i: -self.lengths[i] * (1 + shake(0, noise)))

    def from_patterns(self, patterns: list[list[int]]) -> list[list[int]]:
        """A packing that repeats a neighbour's best bins as far as pieces of those lengths are here."""
        have = defaultdict(list)
        for i, size in enumerate(self.lengths):
            have[size].append(i)
        bins = []
        for pattern in patterns:
            taken: list[int] = []
            for size in pattern:
                if not have[size]:
                    break
                taken.append(have[size].pop())
            if len(taken) == len(pattern):
                bins.append(taken)
            else:
                for i in taken:
                    have[self.lengths[i]].append(i)
        return self.best_fit(bins, self.by_size([i for left in have.values() for i in left]))

    def cross(self, host: list[list[int]], donor: list[list[int]]) -> list[list[int]]:
        """Well-filled bins of the donor whole; the host's bins that share no piece with them; the rest by best fit."""
        ranked = sorted(donor, key=self.fill, reverse=True)
        injected = [list(b) for b in ranked[: max(1, len(ranked) // 2)] if self.random.random() < 0.5]
        used = {i for b in injected for i in b}
        kept, loose = [], []
        for b in host:
            if used.isdisjoint(b):
                kept.append(list(b))
            else:
                loose += [i for i in b if i not in used]
        worst = sorted(kept, key=self.fill)[: max(1, len(kept) // 20)]
        emptied = {id(b) for b in worst}
        loose += [i for b in worst for i in b]
        return self.best_fit(injected + [b for b in kept if id(b) not in emptied], self.by_size(loose))

    def score(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then room gathered in few of them."""
        return -len(bins), sum((self.fill(b) / self.capacity) ** 2 for b in bins)

    def evolve(self, elite: list[list[int]], population: int, generations: int) -> list[list[int]]:
        everything = list(range(len(self.lengths)))
        crowd = [self.best_fit([], self.by_size(everything, noise)) for noise in (0.0, *[0.3] * (population - 1))]
        if elite:
            crowd.append(self.from_patterns(elite))
        least = -(-sum(self.lengths) // self.capacity)
        scored = sorted(((self.score(b), k, b) for k, b in enumerate(crowd)), reverse=True)
        serial = len(crowd)
        for _ in range(generations):
            host, donor = self.random.sample(scored[:population], 2) if len(scored) > 1 else (scored[0], scored[0])
            child = self.cross(host[2], donor[2])
            scored.append((self.score(child), serial, child))
            serial += 1
            scored = sorted(scored, reverse=True)[:population]
            if -scored[0][0][0] == least and self.capacity * least - sum(self.lengths) < self.capacity // 8:
                break
        return scored[0][2]


def pack(items: DataFrame, capacity: int, island_size: int = 2_048, population: int = 4, generations: int = 24, epochs: int = 3, elite: int = 32) -> DataFrame:
    """Every piece with the sequence it goes to and its offset there.

    items: the columns of pieces(), length from 1 to capacity. Islands get about island_size pieces by a hash
    of the row's place, so neither one document nor equal rows can swell one. Pieces of capacity
    fill a sequence by themselves. An empty table gives an empty one.
    """

    def island(epoch: int, last: bool, islands: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(rows: pa.Table, elites: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.schema(ARROW).empty_table()
            number = rows["island"][0].as_py()
            rows = rows.drop_columns("island").sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
            lengths = rows["length"].to_pylist()
            here = Island(lengths, capacity, number * 1_000 + epoch)
            bins = here.evolve(elites["pattern"].to_pylist(), population, generations)
            sequence, offset, settled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.ones(len(lengths), bool)
            for k, b in enumerate(bins):
                sequence[b] = (epoch << 56) + (number << 20) + k
                offset[b] = np.cumsum([0, *(lengths[i] for i in b[:-1])])
                settled[b] = last or here.fill(b) == capacity
            more = [sequence, offset, settled, pa.nulls(len(lengths), pa.list_(pa.int32())), np.full(len(lengths), number)]
            out = pa.table([*rows.columns, *map(pa.array, more)], schema=pa.schema(ARROW))
            best = [] if last else [sorted((lengths[i] for i in b), reverse=True) for b in sorted(bins, key=here.fill, reverse=True) if len(b) > 1][:elite]
            guests = {"pattern": best, "island": [(number + 1) % islands] * len(best)}
            blank = [pa.array(guests[f.name], f.type) if f.name in guests else pa.nulls(len(best), f.type) for f in pa.schema(ARROW)]
            return pa.concat_tables([out, pa.table(blank, schema=pa.schema(ARROW))])

        return run

    def place(df: DataFrame, islands: int) -> DataFrame:
        return df.withColumn("island", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(islands)))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest = materialize(items.select(columns))
    full = rest.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62))
    done = [full.withColumn("offset", F.lit(0).cast("long"))]
    todo, elites = rest.filter(F.col("length") < capacity), rest.limit(0).select(F.lit(None).cast("array<int>").alias("pattern"), F.lit(0).cast("long").alias("island"))
    for epoch in range(epochs):
        last = epoch == epochs - 1
        islands = max(1, -(-todo.count() // island_size))
        dealt = place(todo.select(columns), islands).groupBy("island")
        guests = elites.withColumn("island", F.pmod("island", F.lit(islands))).groupBy("island")
        evolved = materialize(dealt.cogroup(guests).applyInArrow(island(epoch, last, islands), EVOLVED))
        done.append(evolved.filter("settled"))
        todo = evolved.filter("not settled and length is not null")
        elites = evolved.filter("pattern is not null").select("pattern", "island")
    first, *others = [d.select(*columns, "sequence_id", "offset") for d in done]
    for d in others:
        first = first.unionByName(d)
    return first
