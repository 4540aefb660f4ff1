"""Queries of record linkage. The oracles pair everything by brute force; the engine does not."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripledger.functions import amounts
from tripledger.operators import fx, matching
from tripledger.plans.bindings import oracle, view
from tripledger.plans.oracle_parts import AUDIT, FX, MATCH
from tripledger.plans.registry import query
from tripledger.plans.tables import groups, matched_groups, rates, receipt_sides

BASE = "receipts statement_legs fx_observations"
PARTS = ",".join([FX, AUDIT, MATCH])


def match_oracle(body: str, more: str = "", views: str = "") -> str:
    return oracle(f"{BASE} {views}", body, PARTS + more)


@query(
    "fx4_estimate_receipt_cad",
    match_oracle("SELECT trip_id, source_file, currency, share, fx_rate, estimated_cad FROM estimates"),
)
def _(spark, d):
    plain = matching.receipt_side(view(spark, d, "receipts")).drop("estimated_cad")
    return fx.estimate_receipt_cad(plain, groups(spark, d).filter("match_eligible"), rates(spark, d))


def _matched_pairs(spark, d):
    """Receipt and card columns of each group's best match (one row per group)."""
    side, g = receipt_sides(spark, d)
    best = matching.best_match(side, g)
    return best.join(
        side.select("trip_id", "source_file", "receipt_date", "vendor", "currency", "share", "estimated_cad"),
        ["trip_id", "source_file"],
    )


def _key_pairs(spark, d):
    """Receipts beside the card group of the same purchase number: a linear set of pairs for scalar rules."""
    side = matching.receipt_side(view(spark, d, "receipts")).withColumn(
        "group_id", F.concat(F.lit("g"), F.substring("source_file", 2, 8))
    )
    g = groups(spark, d).filter("match_eligible").select(
        "trip_id", "group_id", "transaction_date", "description", "purchase_amount", "purchase_currency",
        "cad_amount", F.abs("purchase_amount").alias("purchase_abs"), F.abs("cad_amount").alias("cad_abs"),
    )
    return side.join(g, ["trip_id", "group_id"])


KEYED = "substr(source_file, 2, 8) = substr(group_id, 2, 8)"


_DATE = "CASE WHEN delta = 0 THEN 0.30 WHEN delta <= 3 THEN greatest(0.00, 0.24 - 0.05 * delta) ELSE 0.00 END"
_AMOUNT = "CASE WHEN same_amount THEN 0.36 WHEN fx_amount THEN 0.46 WHEN number_amount THEN 0.18 WHEN has_gap THEN 0.22 ELSE 0.00 END"


@query(
    "join1_candidate_pairs",
    match_oracle(
        f"""SELECT 'date' AS kind, trip_id, vendor, description, receipt_date, transaction_date, min(lower(source_file)) AS first_file
FROM scored WHERE delta <= 3 AND {_DATE} + 0.46 * same_text >= 0.35 GROUP BY 1, 2, 3, 4, 5, 6
UNION ALL SELECT 'word', trip_id, vendor, description, NULL, NULL, min(lower(source_file)) FROM scored WHERE same_text = 1 GROUP BY 1, 2, 3, 4"""
    ),
)
def _(spark, d):
    """Pairs of features that meet without an amount: by a near date, and by words alone."""
    side, g = receipt_sides(spark, d)
    pairs = matching.evidence_pairs(side, matching.card_rows(g)).filter("kind in ('date', 'word')")
    dated = lambda c: F.when(F.col("kind") == "date", F.col(c)).alias(c)
    cols = ["kind", "trip_id", "vendor", "description", "receipt_date", "transaction_date"]
    rows = pairs.select("kind", "trip_id", "vendor", "description", dated("receipt_date"), dated("transaction_date"), F.col("first.file_key").alias("first_file"))
    return rows.groupBy(*cols).agg(F.min("first_file").alias("first_file"))


@query(
    "join2_band_pairs",
    match_oracle(
        f"""SELECT 'both' AS kind, trip_id, vendor, description, receipt_date, transaction_date, share, p_abs AS purchase_abs, c_abs AS cad_abs,
       CAST(max(score) AS DECIMAL(6,3)) AS score
FROM scored WHERE delta <= 3 AND share IS NOT NULL AND (same_amount OR fx_amount OR number_amount OR has_gap) AND score >= 0.35 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9
UNION ALL SELECT 'amount', trip_id, vendor, description, NULL, NULL, share, p_abs, c_abs, CAST(max({_AMOUNT} + 0.46 * same_text) AS DECIMAL(6,3))
FROM scored WHERE share IS NOT NULL AND (same_amount OR fx_amount OR number_amount OR has_gap) AND {_AMOUNT} + 0.46 * same_text >= 0.35 GROUP BY 1, 2, 3, 4, 7, 8, 9"""
    ),
)
def _(spark, d):
    """Pairs of features that meet by an amount: alone, and together with a near date."""
    side, g = receipt_sides(spark, d)
    pairs = matching.evidence_pairs(side, matching.card_rows(g)).filter("kind in ('amount', 'both')")
    dated = lambda c: F.when(F.col("kind") == "both", F.col(c)).alias(c)
    cols = ["kind", "trip_id", "vendor", "description", "receipt_date", "transaction_date", "share", "purchase_abs", "cad_abs"]
    rows = pairs.select("kind", "trip_id", "vendor", "description", dated("receipt_date"), dated("transaction_date"), "share", "purchase_abs", "cad_abs", "score")
    return rows.groupBy(*cols).agg(F.max("score").cast("decimal(6,3)").alias("score"))


@query("scr1_match_score", match_oracle(f"SELECT trip_id, source_file, group_id, score FROM scored WHERE {KEYED}"))
def _(spark, d):
    side, g = receipt_sides(spark, d)
    pairs = _key_pairs(spark, d).drop("estimated_cad").join(
        side.select("trip_id", "source_file", "estimated_cad"), ["trip_id", "source_file"]
    )
    return matching.score_pairs(pairs, matching.CARD_CENTRIC).select(
        "trip_id", "source_file", "group_id", F.col("score").cast("decimal(6,3)").alias("score")
    )


SCR2 = """, permissive AS (
  SELECT *, purchase_amount AS f, cad_amount AS c,
         coalesce(abs(share - purchase_amount) <= greatest(0.03, share * 0.015), false) AS ex,
         coalesce(abs(share - cad_amount) <= greatest(0.03, share * 0.015), false) AS num,
         coalesce(purchase_amount > 0 AND share > purchase_amount AND round_even(CAST(share AS DOUBLE) / CAST(purchase_amount AS DOUBLE), 0) BETWEEN 2 AND 12
           AND abs(CAST(share AS DOUBLE) / CAST(purchase_amount AS DOUBLE) - round_even(CAST(share AS DOUBLE) / CAST(purchase_amount AS DOUBLE), 0)) <= 0.08, false) AS sp,
         coalesce(cad_amount > 0 AND share > cad_amount AND round_even(CAST(share AS DOUBLE) / CAST(cad_amount AS DOUBLE), 0) BETWEEN 2 AND 12
           AND abs(CAST(share AS DOUBLE) / CAST(cad_amount AS DOUBLE) - round_even(CAST(share AS DOUBLE) / CAST(cad_amount AS DOUBLE), 0)) <= 0.08, false) AS spc
  FROM scored)"""


@query(
    "scr2_match_score_permissive",
    match_oracle(
        f"""SELECT trip_id, source_file, group_id, CAST(least(1,
      CASE WHEN delta = 0 THEN 0.30 WHEN delta <= 3 THEN greatest(0.00, 0.24 - 0.05 * delta) ELSE 0.00 END
    + CASE WHEN share IS NULL THEN 0.00 WHEN ex THEN 0.36 WHEN sp THEN 0.28 WHEN currency = 'CAD' AND num THEN 0.36
           WHEN currency = 'CAD' AND spc THEN 0.28 WHEN num THEN 0.18 WHEN has_gap THEN 0.22 ELSE 0.00 END
    + CASE WHEN delta = 0 AND share IS NOT NULL AND (ex OR (NOT sp AND ((currency = 'CAD' AND num) OR (NOT (currency = 'CAD' AND spc) AND num)))) THEN 0.08 ELSE 0.00 END
    + 0.46 * same_text) AS DECIMAL(6,3)) AS score
FROM permissive WHERE {KEYED}""",
        SCR2,
    ),
)
def _(spark, d):
    return matching.score_pairs_permissive(_key_pairs(spark, d)).select(
        "trip_id", "source_file", "group_id", F.col("score").cast("decimal(6,3)").alias("score")
    )


@query("scr3_candidate_score", match_oracle(f"SELECT trip_id, source_file, group_id, score3 AS score FROM scored WHERE {KEYED}"))
def _(spark, d):
    side, g = receipt_sides(spark, d)
    pairs = _key_pairs(spark, d).drop("estimated_cad").join(
        side.select("trip_id", "source_file", "estimated_cad"), ["trip_id", "source_file"]
    )
    return matching.score_pairs(pairs, matching.RECEIPT_CENTRIC).select(
        "trip_id", "source_file", "group_id", F.col("score").cast("decimal(6,3)").alias("score")
    )


@query(
    "tok1_token_hit",
    """SELECT p_partkey, list_has_any(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 2 AND contains(lower(p_type), t)),
       string_split(lower(p_name), ' ')) AS hit FROM part""",
)
def _(spark, d):
    from tripledger.functions.similarity import token_hit
    from tripledger.plans.bindings import table

    return table(spark, d, "part").select(
        "p_partkey", token_hit(F.col("p_name"), F.col("p_type")).alias("hit")
    )


@query("sim1_text_similarity")
def _(spark, d):
    from tripledger.functions.similarity import text_similarity
    from tripledger.plans.bindings import table

    distinct = table(spark, d, "part").select("p_name", "p_type").distinct()
    return distinct.select("p_name", "p_type", text_similarity(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query(
    "amt1_close_amount",
    match_oracle(f"SELECT trip_id, source_file, number_amount, fx_amount FROM scored WHERE {KEYED}"),
)
def _(spark, d):
    side, _ = receipt_sides(spark, d)
    pairs = _key_pairs(spark, d).drop("estimated_cad").join(
        side.select("trip_id", "source_file", "estimated_cad"), ["trip_id", "source_file"]
    )
    return pairs.select(
        "trip_id",
        "source_file",
        F.coalesce(amounts.close_amount(F.col("share"), F.col("cad_abs")), F.lit(False)).alias("number_amount"),
        F.coalesce(amounts.close_fx_amount(F.col("estimated_cad"), F.col("cad_abs")), F.lit(False)).alias("fx_amount"),
    )


@query("amt2_card_gap_percent", match_oracle(f"SELECT trip_id, source_file, gap_percent FROM scored WHERE {KEYED}"))
def _(spark, d):
    return _key_pairs(spark, d).select(
        "trip_id", "source_file", amounts.card_gap_percent(F.col("share"), matching.card_side()).alias("gap_percent")
    )


@query(
    "amt3_split_amount",
    match_oracle(
        f"""SELECT trip_id, source_file, CASE WHEN sp THEN CAST(round_even(CAST(share AS DOUBLE) / CAST(purchase_amount AS DOUBLE), 0) AS INTEGER) END AS people
FROM permissive WHERE {KEYED}""",
        SCR2,
    ),
)
def _(spark, d):
    return _key_pairs(spark, d).select(
        "trip_id", "source_file", amounts.split_people(F.col("share"), F.col("purchase_amount")).alias("people")
    )


@query("amt4_per_person_share", match_oracle("SELECT trip_id, source_file, share FROM receipts_s"))
def _(spark, d):
    return matching.receipt_side(view(spark, d, "receipts")).select("trip_id", "source_file", "share")


@query(
    "rnk1_best_match",
    match_oracle("SELECT trip_id, group_id, source_file, score FROM best"),
)
def _(spark, d):
    side, g = receipt_sides(spark, d)
    return matching.best_match(side, g).select(
        "trip_id", "group_id", "source_file", F.col("score").cast("decimal(6,3)").alias("score")
    )


@query(
    "rnk2_auto_assign",
    match_oracle("SELECT trip_id, group_id, matched_file, suggested_file, match_status, match_confidence FROM matched"),
)
def _(spark, d):
    _, matched = matched_groups(spark, d)
    return matched.select("trip_id", "group_id", "matched_file", "suggested_file", "match_status", "match_confidence")


@query("rnk3_review_reason", match_oracle("SELECT trip_id, group_id, review_reason FROM matched WHERE review_reason <> ''"))
def _(spark, d):
    _, matched = matched_groups(spark, d)
    return matched.filter("review_reason <> ''").select("trip_id", "group_id", "review_reason")


RNK4 = """, suggestion AS (
  SELECT s.trip_id, s.source_file, s.group_id, s.score3 AS score, s.score3 >= 0.35 AS likely,
         coalesce(m.matched_file = s.source_file, false) AS current, coalesce(m.suggested_file = s.source_file, false) AS suggested
  FROM scored s JOIN matched m ON m.trip_id = s.trip_id AND m.group_id = s.group_id),
suggestion_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trip_id, source_file ORDER BY current DESC, suggested DESC, likely DESC, score DESC, group_id) AS rank
  FROM suggestion WHERE current OR suggested OR likely)"""


@query(
    "rnk4_top_suggestions",
    match_oracle(
        "SELECT trip_id, source_file, group_id, score, likely, current, suggested, rank FROM suggestion_ranked WHERE rank <= 12",
        RNK4,
    ),
)
def _(spark, d):
    side, matched = matched_groups(spark, d)
    return matching.suggestions(side, matched).select(
        "trip_id", "source_file", "group_id", "score", "likely", "current", "suggested", "rank"
    )
