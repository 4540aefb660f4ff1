"""BPE encoding and decoding of text columns by speculation and verification (see word_bpe)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.arrow_rows import id_lists, map_rows
from tripledger.llm.word_bpe import codec


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token ids of each document: (doc_id, ids array<int>).

    docs: doc_id, text; other columns are not read. Null and empty texts give an empty list; repeated
    rows are encoded each; an empty table gives an empty one. vocabulary: path of a tokenizer file
    that every executor can open.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(vocabulary).encode_batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), id_lists(ids)], ["doc_id", "ids"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """Text of each id list: (doc_id, ids, text). A null list decodes to an empty text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else [0]
        names = np.array(codec(vocabulary).token_text, object)[lists.flatten().to_numpy()].tolist()
        cut = np.asarray(offsets).tolist() if not lists.null_count else np.r_[0, np.cumsum([len(x or []) for x in lists.to_pylist()])].tolist()
        texts = [" ".join(names[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_rows(tokens.select("doc_id", "ids"), make, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and hashes of ids and decoded texts."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
