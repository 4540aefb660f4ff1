"""Fill-in-middle transformation: texts cut at unit borders that are found by word-wide arithmetic on their UTF-8.

The texts of a batch stand in one buffer that is viewed as 64-bit words. Unit-ending bytes are marked in
all words at once, marks are counted per word (bitwise_count), the running counts are searched for the
word that holds a wanted mark, and a prefix-sum multiplication finds the byte within it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.arrow_rows import map_rows

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_HIGH, _ONES = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)


class UnitEnds:
    """Rank and select over the code-point-ending bytes of a buffer of valid UTF-8."""

    def __init__(self, raw: bytes | memoryview):
        self.size = len(raw)
        padded = np.zeros((self.size // 8 + 2) * 8, np.uint8)
        padded[: self.size] = np.frombuffer(raw, np.uint8)
        words = padded.view("<u8")
        # a continuation byte has its high bit set and the next one clear; any other byte starts a unit
        starts = _HIGH & ~(words & ~(words << np.uint64(1)))
        # the byte before a start ends a unit; the padding after the text is a start as well
        self._ends = starts[:-1] >> np.uint64(8) | starts[1:] << np.uint64(56)
        self._trim()
        self._before = np.zeros(len(self._ends) + 1, np.int64)
        np.cumsum(np.bitwise_count(self._ends), out=self._before[1:])

    def _trim(self) -> None:
        """No marks behind the last byte."""
        last = self.size // 8
        self._ends[last] &= (np.uint64(1) << np.uint64(8 * (self.size % 8))) - np.uint64(1)
        self._ends[last + 1 :] = 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = self._ends[word] & ((np.uint64(1) << (np.uint64(8) * byte)) - np.uint64(1))
        return self._before[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte position behind the first k units, for each k."""
        word = np.searchsorted(self._before, k, side="left") - 1  # before[word] < k <= before[word + 1]
        word = np.maximum(word, 0)
        left = np.minimum(k - self._before[word], 8).astype(np.uint64)
        sums = (self._ends[word] >> np.uint64(7)) * _ONES  # each byte: marks up to it
        reached = ((sums | _HIGH) - left * _ONES) & _HIGH  # bytes with at least that many
        inside = 9 - np.bitwise_count(reached).astype(np.int64)
        return np.where(k > 0, (word << 3) + inside, 0)


def draws(seed: int, doc_ids: list[int | None]) -> np.ndarray:
    """Four 32-bit numbers for each document: the head of the sha256 of seed, colon and decimal id (nothing for null)."""
    heads = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids]
    return np.frombuffer(b"".join(heads), ">u4").reshape(-1, 4).astype(np.int64)


def _checked(markers: tuple[str, str, str]) -> list[bytes]:
    """Markers that can be found again wherever they stand: the first letter of one occurs nowhere else in any."""
    firsts = {m[:1] for m in markers}
    if "" in firsts or len(set(markers)) < 3 or any(c in m[1:] for m in markers for c in firsts) or any(a != b and b.startswith(a) for a in markers for b in markers):
        raise ValueError(f"markers {markers} cannot be told from the text around them")
    return [m.encode() for m in markers]


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Each text with a random middle moved behind its suffix: (doc_id, n, form, prefix_chars, middle_chars, output).

    docs: doc_id, text; other columns are not read. n counts code points. Null and empty texts stay plain
    (output empty, n 0), and so does a text that holds a marker. The draw depends on seed and doc_id alone, so a
    repeated doc_id is cut by the same draw; a null doc_id draws as an empty id. An empty table gives an empty one.
    """
    before, between, behind = _checked(markers)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode("utf-8") if t else b"" for t in batch.column(1).to_pylist()]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = ends - np.fromiter(map(len, texts), np.int64, len(texts))
        units = UnitEnds(b"".join(texts))
        first = units.rank(starts)
        n = units.rank(ends) - first
        h = draws(seed, batch.column(0).to_pylist())
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        # a text's first units are counted from its own start, so that a cut of 0 is the start itself
        a = (np.where(low > 0, units.select(first + low), starts) - starts).tolist()
        b = (np.where(high > 0, units.select(first + high), starts) - starts).tolist()
        chosen = np.where(h[:, 2] % 100 >= fim_percent, PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM)).tolist()
        form, out = [], []
        for t, i, j, f in zip(texts, a, b, chosen, strict=True):
            if not t or before in t or between in t or behind in t:
                f = PLAIN
            form.append(f)
            if f == PLAIN:
                out.append(t)
            elif f == PSM:
                out.append(b"".join((before, t[:i], between, t[j:], behind, t[i:j])))
            else:
                out.append(b"".join((between, t[j:], before, t[:i], behind, t[i:j])))
        moved = np.array([f != PLAIN for f in form], bool)
        sizes = [pa.array(np.where(moved, x, 0), pa.int64(), mask=~moved) for x in (low, high - low)]
        columns = [batch.column(0), pa.array(n), pa.array(form, pa.string()), *sizes, pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"), make,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restore(rows: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """rows with the text rebuilt from output and form alone, as column restored.

    A plain or null form gives the output as it is; a null output gives null.
    """
    _checked(markers)
    before, between, behind = (F.lit(m) for m in markers)
    output = F.col("output")

    def inside(left: Column, right: Column) -> Column:
        """What stands between two markers, each of which occurs once."""
        return F.split_part(F.split_part(output, left, F.lit(2)), right, F.lit(1))

    middle = F.split_part(output, behind, F.lit(2))
    psm = F.concat(inside(before, between), middle, inside(between, behind))
    spm = F.concat(inside(before, behind), middle, inside(between, before))
    return rows.withColumn("restored", F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(output))


def digest(rows: DataFrame) -> DataFrame:
    """Sizes and hashes of restored rows."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
