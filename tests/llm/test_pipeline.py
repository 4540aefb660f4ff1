"""The pipeline stage by stage against plain versions, and its end result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.llm import plain
from tests.llm.test_operators import VOCABULARY, check_packing
from tripledger.functions.materialize import materialize
from tripledger.llm.word_bpe import codec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def rows_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_stages_keep_columns_and_drop_only_what_they_judge(results):
    docs, good, single, cut, clean, _ = results
    assert all(x.columns == docs.columns for x in (good, single, cut, clean))
    for d, text in rows_of(docs).items():
        n, _, _, _, again = plain.quality_counts(text)
        if n < 20 or 100 * again > 30 * n:
            assert d not in rows_of(good)
    texts = rows_of(good)
    want = plain.near_components(texts)
    assert set(rows_of(single)) == {k for k, v in want.items() if k == v}
    assert set(rows_of(cut)) == set(rows_of(clean)) == set(rows_of(single))


def plain_cut(texts, length=50):
    """Each text without the letters that lose a byte to a passage of an earlier document."""
    seen, out = set(), {}
    for k in sorted(texts):
        raw = texts[k].encode()
        gone = [False] * len(raw)
        own = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + length] = [True] * length
        seen.update(own)
        at, kept = 0, []
        for c in texts[k]:
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out[k] = "".join(kept)
    return out


def test_cut_and_redacted_texts(results):
    _, _, single, cut, clean, _ = results
    assert rows_of(cut) == plain_cut(rows_of(single))
    tagged = {k: (plain.base_spans(t), rows_of(clean)[k]) for k, t in rows_of(cut).items()}
    assert any(spans for spans, _ in tagged.values())
    for k, (spans, text) in tagged.items():
        assert not plain.base_spans(text), k
        assert bool(spans) <= (text != rows_of(cut)[k])
    assert clean.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_packed(results):
    clean, pieces = results[4], results[5]
    ids = {k: [*memoryview(x).cast("I").tolist(), 0] for k, x in zip(rows_of(clean), codec(VOCABULARY).encode_batch(list(rows_of(clean).values())), strict=True)}
    check_packing(pieces.collect(), ids)
    assert pieces.count() == sum(-(-len(x) // 2_048) for x in ids.values())


def test_pipeline_on_odd_rows(spark):
    rows = [(None, "a b c"), (None, None), (1, None), (1, None), (2, " ".join(f"word{i}" for i in range(60))), (2, " ".join(f"word{i}" for i in range(60))), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in ("lang", "source", "kept", "key")})
    docs = docs.withColumn("n_chars", F.lit(None).cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    single = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in single) == ["1", "2", "3", "None", "None"]
    assert corpus_pipeline.packed(spark, docs, SF).count() == len(rows)


def test_registered():
    names = set(entry_module.queries())
    assert {"pipeline"} | {f"op{n}_" for n in range(1, 14)} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}
