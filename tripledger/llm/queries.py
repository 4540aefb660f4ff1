"""Registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize, scratch_path
from tripledger.llm import bpe_codec, fim, language, lexical, licenses, line_runs, minhash, packing, pii, quality, simhash, suffix_dedup, token_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: list[tuple[str, Query, str | None]] = []
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 2_048


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES.append((fn.__name__, fn, sql))
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register()
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(documents(spark, sf_dir))


@register()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.search(documents(spark, sf_dir))


@register()
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in the directory of its source, language and block of fifty ids."""
    block = F.floor(F.col("doc_id") / 50).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), block, F.col("doc_id").cast("string"))
    return licenses.scan(documents(spark, sf_dir).withColumn("path", path))


@register()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


@register()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), VOCABULARY, end_id=0, capacity=SEQUENCE), SEQUENCE)


@register()
def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


@register()
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove(documents(spark, sf_dir)))


@register()
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(bpe_codec.decode(bpe_codec.encode(documents(spark, sf_dir), VOCABULARY), VOCABULARY))


@register()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark)
    token_files.write(documents(spark, sf_dir), VOCABULARY, end_id=1, folder=folder)
    return token_files.digest(token_files.read(spark, folder))


@register()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(language.learning_rows(docs))).withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    )


_BARE = "coalesce(text, '')"
_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register(
    f"""WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_A_TO_Z}) AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split({_BARE}, chr(10)) AS ls FROM documents))),
held AS (SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, holder IS NOT NULL AND doc_id <> holder AS gone FROM lines LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(line_runs.deduplicate(documents(spark, sf_dir)))


@register(
    f"""WITH drawn AS (
  SELECT doc_id, {_BARE} AS t, length({_BARE})::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
numbers AS (SELECT doc_id, t, n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM drawn),
cuts AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM parts"""
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.restore(fim.transform(documents(spark, sf_dir))))


_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


@register(
    f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate({_BARE}, {_A_TO_Z}), {_TERMS})) AS term FROM documents),
held AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term, docs),
norms AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM sizes, totals),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate({_BARE}, {_A_TO_Z}), {_TERMS})) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(lexical.index(documents(spark, sf_dir)))
    return lexical.search(found, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
