"""Language by error-correcting output codes.

Each language has a codeword; one binary classifier for each bit, linear in hashed character n-grams, separates the
languages with that bit from those without. A text goes to the codeword of the smallest weighted loss; a close
second marks it as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.arrow_rows import map_rows, slices

BUCKETS = 1 << 14
LONGEST_GRAM = 3
MOST_BITS = 31
SALTS = 1_024
UNKNOWN = "und"
_TIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_PLAIN = np.arange(0x300, dtype=np.uint32)
for _c in range(0x300):
    if not chr(_c).isalpha():
        _PLAIN[_c] = 32


def grams(text: str) -> np.ndarray:
    """Bucket of every 1-, 2- and 3-gram of the lower-cased text; what is no letter counts as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(points < 0x300, _PLAIN[np.minimum(points, 0x2FF)], points)
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    out, h = [], np.zeros(len(points), np.uint32)
    for k in range(LONGEST_GRAM):
        h = (h[: len(points) - k] if k else h) * np.uint32(0x01000193) + points[k:] * np.uint32(_TIMES[k])
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18))
        h = h[:-1]
    return np.concatenate(out)


def counts(text: str) -> np.ndarray:
    """Damped share of each bucket in the text."""
    n = np.sqrt(np.bincount(grams(text), minlength=BUCKETS).astype(np.float32))
    return n / n.sum()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the doc_id's digits is not 2 modulo 4, language and text given."""
    return docs.filter((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def profiles(docs: DataFrame) -> DataFrame:
    """(lang, n documents, sums of their bucket shares) over all rows: one row for each language and task, summed by language."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + counts(text)
                    n[lang] = n.get(lang, 0) + 1
        kept = sorted(sums)
        columns = [pa.array(kept, pa.string()), pa.array([n[k] for k in kept], pa.int64()), pa.array([sums[k].astype(np.float32).tobytes() for k in kept], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "sums"])

    def add(batch: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS)
        for x in batch["sums"].to_pylist():
            total += np.frombuffer(x, np.float32)
        return pa.table({"lang": batch["lang"][:1], "n": pa.array([sum(batch["n"].to_pylist())], pa.int64()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    parts = docs.select("lang", "text").mapInArrow(summed, "lang string, n long, sums binary")
    # two steps, so that a language that holds most rows is not summed in one task
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(SALTS)))
    first = salted.groupBy("lang", "salt").applyInArrow(lambda t: add(t.select(["lang", "n", "sums"])), "lang string, n long, sums binary")
    return first.groupBy("lang").applyInArrow(add, "lang string, n long, sums binary")


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    bit_weight: np.ndarray


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages: all ways to split few languages in two; for many, fixed random splits, far from each other."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= MOST_BITS:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=n - 1) if -1 in bits], float).T
    rng = np.random.default_rng(7)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, max(MOST_BITS, 4 * int(np.ceil(np.log2(n))))))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


def fit(docs: DataFrame) -> Model:
    """Learns from all given rows (lang, text). The driver gets one profile for each language, nothing by row."""
    rows = sorted(profiles(docs).collect(), key=lambda r: r.lang)
    langs = [r.lang for r in rows]
    mean = np.array([np.frombuffer(r.sums, np.float32) / r.n for r in rows]).reshape(len(rows), BUCKETS)
    code = codewords(len(langs))
    smooth = 1.0 / (50 * BUCKETS)
    weights, bias, worth = [], [], []
    for bit in code.T:
        if not len(langs) or abs(bit.sum()) == len(bit):
            weights.append(np.zeros(BUCKETS))
            bias.append(1.0)
            worth.append(1.0)
            continue
        ones, others = mean[bit > 0].mean(axis=0), mean[bit < 0].mean(axis=0)
        w = np.log((ones + smooth) / (others + smooth))
        reach = mean @ w
        low, high = reach[bit > 0].min(), reach[bit < 0].max()
        scale = 2.0 / max(abs(low - high), 1e-6)
        weights.append(w * scale)
        bias.append(-scale * (low + high) / 2)
        worth.append(max(low - high, 1e-3))  # how far apart the two sides are on their profiles
    worth = np.array(worth) / np.sum(worth) if worth else np.zeros(0)
    return Model(langs, code, np.array(weights, np.float32).T, np.array(bias), worth)


def _predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    if not has_letter(text) or not model.langs:
        return UNKNOWN, 0.0, True
    margins = counts(text) @ model.weights + model.bias
    loss = np.exp(-np.clip(model.code * margins, -4, 4)) @ model.bit_weight
    likely = np.exp(-3.0 * (loss - loss.min()))
    likely /= likely.sum()
    first = int(likely.argmax())
    second = np.partition(likely, -2)[-2] if len(likely) > 1 else 0.0
    return model.langs[first], float(likely[first]), bool(second > 0.5 * likely[first])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of each row of docs (doc_id, text; other columns are not read).

    A null or empty text, or one without a letter, is "und" with score 0, and so is every text if nothing was learned. Ties go to
    the first language by name. Repeated rows are predicted each; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers, whatever the corpus

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = [_predict(shared.value, t) for t in batch.column(1).to_pylist()]
        lang, score, close = zip(*said, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double, ambiguous boolean")
