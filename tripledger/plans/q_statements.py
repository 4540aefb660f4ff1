"""Queries over statement legs: FX, exact CAD, duplicates, completeness, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripledger.operators import fx, statements
from tripledger.plans.bindings import LEG_COLUMNS, oracle, view
from tripledger.plans.oracle_parts import AUDIT, FX
from tripledger.plans.registry import query
from tripledger.plans.tables import cad_legs, groups, rates

RATE_COLS = ["currency", "week_start", "week_end", "cad_per_unit", "method", "route", "observation_count"]


@query(
    "fx1_weekly_rates",
    oracle("fx_observations", f"SELECT {', '.join(RATE_COLS)} FROM fx_direct", FX),
)
def _(spark, d):
    return fx.weekly_rates(view(spark, d, "fx_observations")).select(*RATE_COLS)


@query(
    "fx2_pegged_rate",
    oracle("fx_observations", f"SELECT {', '.join(RATE_COLS)} FROM fx_rates WHERE currency = 'QAR'", FX),
)
def _(spark, d):
    return fx.pegged_rates(fx.weekly_rates(view(spark, d, "fx_observations"))).select(*RATE_COLS)


@query(
    "fx3_identity_rate",
    oracle(
        "statement_legs fx_observations",
        """SELECT trip_id, leg_id, purchase_currency,
       CASE WHEN purchase_currency = 'CAD' THEN CAST(1 AS DECIMAL(20,10)) ELSE r.cad_per_unit END AS fx_rate,
       CASE WHEN purchase_currency = 'CAD' THEN 'identity' ELSE r.method END AS fx_method
FROM statement_legs l LEFT JOIN fx_rates r ON r.currency = l.purchase_currency
 AND r.week_start = CAST(date_trunc('week', transaction_date) AS DATE)""",
        FX,
    ),
)
def _(spark, d):
    rated = fx.attach_rates(
        view(spark, d, "statement_legs"), rates(spark, d), "purchase_currency", "transaction_date"
    )
    return rated.select("trip_id", "leg_id", "purchase_currency", "fx_rate", "fx_method")


@query(
    "fx5_rate_cache_merge",
    oracle(
        "statement_legs fx_observations",
        """, stored AS (SELECT currency, week_start, cad_per_unit + 1 AS cad_per_unit FROM fx_rates WHERE day(week_start) % 2 = 0),
needed AS (SELECT DISTINCT purchase_currency AS currency, CAST(date_trunc('week', transaction_date) AS DATE) AS week_start
           FROM statement_legs WHERE purchase_currency <> 'CAD')
SELECT currency, week_start, cad_per_unit FROM stored
UNION ALL
SELECT r.currency, r.week_start, r.cad_per_unit FROM fx_rates r JOIN needed n USING (currency, week_start)
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.currency = r.currency AND s.week_start = r.week_start)""",
        FX,
    ).replace(")\n, stored", "), stored"),
)
def _(spark, d):
    obs = view(spark, d, "fx_observations")
    all_rates = fx.rate_table(obs)
    stored = all_rates.filter(F.day("week_start") % 2 == 0).select(
        "currency", "week_start", (F.col("cad_per_unit") + 1).cast("decimal(20,10)").alias("cad_per_unit")
    )
    needed = view(spark, d, "statement_legs").select(
        F.col("purchase_currency").alias("currency"), F.col("transaction_date").alias("day")
    )
    return fx.merge_rate_cache(stored, needed, obs)


@query(
    "cad1_exact_cad_audit",
    oracle(
        "statement_legs fx_observations",
        "SELECT trip_id, leg_id, cad_rate, cad_route, cad_method FROM legs_audit",
        FX + "," + AUDIT,
    ),
)
def _(spark, d):
    return statements.exact_cad_audit(view(spark, d, "statement_legs")).select(
        "trip_id", "leg_id", "cad_rate", "cad_route", "cad_method"
    )


@query(
    "cad2_apply_weekly_fx",
    oracle(
        "statement_legs fx_observations",
        "SELECT trip_id, leg_id, cad_amount, cad_rate, cad_route, cad_method, cad_week_start FROM legs_cad",
        FX + "," + AUDIT,
    ),
)
def _(spark, d):
    return cad_legs(spark, d).select(
        "trip_id", "leg_id", "cad_amount", "cad_rate", "cad_route", "cad_method", "cad_week_start"
    )


@query(
    "cad3_cad_completeness",
    oracle(
        "statement_legs fx_observations",
        f"""SELECT l.trip_id, l.leg_id, s.cad_completeness,
       CASE WHEN match_eligible AND s.cad_completeness IN ('partial', 'incomplete')
            THEN '{statements.NO_CAD_NOTE}' ELSE '' END AS review_note
FROM statement_legs l JOIN (
  SELECT trip_id, group_id, CASE WHEN count_if(match_eligible) = 0 THEN 'not_applicable'
         WHEN count_if(match_eligible AND cad_amount IS NULL) = 0 THEN 'complete'
         WHEN count_if(match_eligible AND cad_amount IS NOT NULL) > 0 THEN 'partial' ELSE 'incomplete' END AS cad_completeness
  FROM statement_legs GROUP BY 1, 2) s USING (trip_id, group_id)""",
    ),
)
def _(spark, d):
    return statements.cad_completeness(view(spark, d, "statement_legs")).select(
        "trip_id", "leg_id", "cad_completeness", "review_note"
    )


GROUP_COLS = (
    "trip_id, group_id, transaction_date, provider, account_label, description, transaction_type, purchase_amount, "
    "purchase_currency, cad_amount, cad_completeness, cad_method, match_eligible, normalization_status, clean_legs, leg_count"
)


@query(
    "grp1_transaction_groups",
    oracle("statement_legs fx_observations", f"SELECT {GROUP_COLS} FROM txn_groups", FX + "," + AUDIT),
)
def _(spark, d):
    return groups(spark, d).select(*GROUP_COLS.split(", "))


@query(
    "grp1_group_lists",
    oracle(
        "statement_legs",
        """SELECT trip_id, group_id, coalesce(string_agg(s, '; ' ORDER BY a) FILTER (k = 'cad_source'), '') AS cad_source, coalesce(string_agg(s, ' ' ORDER BY a) FILTER (k = 'review_note'), '') AS review_note
FROM (SELECT trip_id, group_id, k, s, min(concat(source_file, lpad(CAST(source_row AS VARCHAR), 12, '0'))) AS a FROM (
  SELECT trip_id, group_id, source_file, source_row, 'cad_source' AS k, CASE WHEN match_eligible THEN concat('rates ', CAST(source_row % 2 AS VARCHAR)) END AS s FROM statement_legs
  UNION ALL SELECT trip_id, group_id, source_file, source_row, 'review_note', CASE WHEN source_row % 4 = 0 THEN '' ELSE concat('note ', CAST(source_row % 3 AS VARCHAR)) END FROM statement_legs)
  WHERE coalesce(s, '') <> '' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    """Legs that name one of two sources and one of three notes."""
    legs = view(spark, d, "statement_legs").withColumns(
        {
            "cad_source": F.concat(F.lit("rates "), (F.col("source_row") % 2).cast("string")),
            "review_note": F.when(F.col("source_row") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("note "), (F.col("source_row") % 3).cast("string"))),
        }
    )
    return statements.group_lists(legs)


@query(
    "grp1_group_matches",
    oracle(
        "statement_legs",
        """SELECT trip_id, group_id, CASE WHEN count(DISTINCT f) FILTER (match_eligible) = 1 THEN min(f) FILTER (match_eligible) END AS matched_file,
       CASE WHEN NOT bool_or(match_eligible) THEN 'audit' WHEN bool_or(match_eligible AND s = 'manual') THEN 'manual' WHEN bool_or(match_eligible AND s = 'auto') THEN 'auto'
            WHEN bool_or(match_eligible AND s = 'suggested') THEN 'suggested' ELSE 'unmatched' END AS match_status,
       max(c) AS match_confidence, max(normalization_status = 'possible_duplicate') AS possible_duplicate, CAST(NULL AS DATE) AS cad_week_end
FROM (SELECT *, CASE source_row % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'suggested' WHEN 2 THEN 'auto' ELSE 'unmatched' END AS s,
  CASE WHEN source_row % 5 < 3 THEN concat('r', CAST(source_row % 2 AS VARCHAR)) END AS f, CAST((source_row % 5) / 10.0 AS DECIMAL(6,3)) AS c FROM statement_legs) GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    """Legs that carry matches of their own."""
    n = F.col("source_row") % 5
    legs = statements.exact_cad_audit(view(spark, d, "statement_legs")).withColumns(
        {
            "match_status": F.when(n == 0, "manual").when(n == 1, "suggested").when(n == 2, "auto").otherwise("unmatched"),
            "matched_file": F.when(n < 3, F.concat(F.lit("r"), (F.col("source_row") % 2).cast("string"))),
            "suggested_file": F.lit(None).cast("string"), "match_confidence": (n / 10).cast("decimal(6,3)"), "review_reason": F.lit(""),
            "cad_week_start": F.lit(None).cast("date"),
        }
    )
    return statements.transaction_groups(legs).select("trip_id", "group_id", "matched_file", "match_status", "match_confidence", "possible_duplicate", "cad_week_end")


DED_COLS = "trip_id, provider, group_id, leg_id, source_file, source_row, purchase_amount"


@query(
    "ded1_dedup_exact",
    oracle(
        "statement_exports",
        f"""SELECT {DED_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY trip_id, provider, group_id, leg_id, transaction_date, settlement_amount,
      settlement_currency, purchase_amount, purchase_currency ORDER BY source_file, source_row) AS rn
  FROM statement_exports) WHERE provider <> 'wise' OR rn = 1""",
    ),
)
def _(spark, d):
    return statements.dedup_exact(view(spark, d, "statement_exports")).select(*DED_COLS.split(", "))


WEAK_SQL = """weak AS (
  SELECT *, CASE WHEN provider <> 'wise' THEN count(*) OVER (PARTITION BY trip_id, provider, account_label, transaction_date,
      trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), settlement_amount, settlement_currency) ELSE 1 END AS copies
  FROM statement_exports)"""


@query(
    "ded2_flag_possible_duplicates",
    oracle(
        "statement_exports",
        f"""SELECT trip_id, leg_id, source_file, copies,
       CASE WHEN copies > 1 THEN 'possible_duplicate' ELSE normalization_status END AS normalization_status,
       CASE WHEN copies > 1 THEN '{statements.DUPLICATE_NOTE}' ELSE review_note END AS review_note
FROM weak""",
        WEAK_SQL,
    ),
)
def _(spark, d):
    return statements.flag_possible_duplicates(view(spark, d, "statement_exports")).select(
        "trip_id", "leg_id", "source_file", "copies", "normalization_status", "review_note"
    )


@query(
    "ded2_duplicate_evidence",
    oracle(
        "statement_exports",
        "SELECT trip_id, copies, source_file, source_row FROM weak WHERE copies > 1",
        WEAK_SQL,
    ),
)
def _(spark, d):
    flagged = statements.flag_possible_duplicates(view(spark, d, "statement_exports"))
    return statements.duplicate_evidence(flagged).drop("dup_key")


@query("set1_union_statements", oracle("statement_legs", f"SELECT {', '.join(LEG_COLUMNS)} FROM statement_legs"))
def _(spark, d):
    """The legs of three providers, each with its columns in another order, in one table."""
    legs = view(spark, d, "statement_legs")
    parts = [legs.filter(F.col("provider") == p).select(*LEG_COLUMNS[i:], *LEG_COLUMNS[:i]) for i, p in enumerate(("amex", "bmo", "wise"))]
    return statements.union_statements(parts).select(*LEG_COLUMNS)


@query("ord1_order_statements", oracle("statement_legs", f"SELECT {', '.join(LEG_COLUMNS)} FROM statement_legs"))
def _(spark, d):
    return statements.order_statements(view(spark, d, "statement_legs").select(*LEG_COLUMNS))
