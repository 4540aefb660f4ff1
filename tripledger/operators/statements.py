"""Set operations and aggregates over statement legs (SET1, ORD1, DED*, CAD*, GRP1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.aggs import append_note, first_row_per_key, one_or_mixed, only_value, sum_or_null
from tripledger.functions.amounts import MONEY, RATE
from tripledger.operators.fx import attach_rates

STABLE_ID_PROVIDERS = ("wise",)  # fixed values: providers whose exports carry a transaction id
LEG_KEY = [
    "trip_id",
    "provider",
    "group_id",
    "leg_id",
    "transaction_date",
    "settlement_amount",
    "settlement_currency",
    "purchase_amount",
    "purchase_currency",
]
LEG_ORDER = ["source_file", "source_row"]
NO_CAD_NOTE = "No complete CAD amount is available; use a manual CAD override after matching."
DUPLICATE_NOTE = "Possible duplicate: same provider, account, date, description, amount, and currency."


def union_statements(parts: list[DataFrame]) -> DataFrame:
    """SET1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def order_statements(legs: DataFrame) -> DataFrame:
    """ORD1: a global range sort, meant for sinks."""
    return legs.orderBy(
        F.col("transaction_date").asc_nulls_last(), "provider", "group_id", "source_file", "source_row"
    )


def cleaned_description(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _has_stable_ids() -> Column:
    return F.coalesce(F.col("provider").isin(*STABLE_ID_PROVIDERS), F.lit(False))


def dedup_exact(legs: DataFrame) -> DataFrame:
    """DED1: overlapping exports of stable-id providers keep the first copy of a leg; a leg without provider has no stable id."""
    stable = _has_stable_ids()
    kept = first_row_per_key(legs.filter(stable), LEG_KEY, LEG_ORDER)
    return legs.filter(~stable).unionByName(kept)


def _weak_key() -> Column:
    return F.md5(
        F.to_json(
            F.struct(
                "trip_id",
                "provider",
                "account_label",
                "transaction_date",
                cleaned_description(F.col("description")).alias("d"),
                "settlement_amount",
                "settlement_currency",
            )
        )
    )


def flag_possible_duplicates(legs: DataFrame) -> DataFrame:
    """DED2: rows of other providers that look alike are all flagged, none is removed.

    Counts are aggregated first and only the keys that repeat are joined back: unique rows (the
    bulk) meet a small key table, and a key with very many copies is one row on that side, which
    AQE's skew join can split on the other.
    """
    stable = _has_stable_ids()
    keyed = legs.filter(~stable).withColumn("dup_key", _weak_key())
    repeated = keyed.groupBy("dup_key").agg(F.count("*").alias("copies")).filter("copies > 1")
    # rows with stable ids have no key and stay out of the join
    others = legs.filter(stable).select(F.lit(None).cast("string").alias("dup_key"), *legs.columns, F.lit(None).cast("bigint").alias("copies"))
    hit = F.col("copies").isNotNull()
    return (
        keyed.join(repeated, "dup_key", "left")
        .unionByName(others)
        .withColumn(
            "normalization_status",
            F.when(hit, F.lit("possible_duplicate")).otherwise(F.col("normalization_status")),
        )
        .withColumn(
            "review_note",
            F.when(hit, append_note(F.col("review_note"), F.lit(DUPLICATE_NOTE))).otherwise(
                F.col("review_note")
            ),
        )
        .withColumn("dup_key", F.when(hit, F.col("dup_key")))
        .withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))
    )


def duplicate_evidence(flagged: DataFrame) -> DataFrame:
    """Evidence as rows (one per copy), so a set of copies of any size stays distributed."""
    return flagged.filter(F.col("dup_key").isNotNull()).select(
        "trip_id", "dup_key", "copies", "source_file", "source_row"
    )


def exact_cad_audit(legs: DataFrame) -> DataFrame:
    """CAD1: why a row already has an exact CAD amount."""
    exact = F.col("cad_amount").isNotNull() & F.col("match_eligible")
    cur = F.col("purchase_currency")
    has_basis = (F.coalesce(F.col("purchase_amount"), F.lit(0)) != 0) & (F.coalesce(cur, F.lit("")) != "")
    settled_cad = F.coalesce(F.col("settlement_currency") == "CAD", F.lit(False))
    bought_cad = F.coalesce(cur == "CAD", F.lit(False))
    ratio = (F.abs("cad_amount") / F.abs("purchase_amount")).cast(RATE)
    provider = F.upper("provider")
    return legs.withColumns(
        {
            "cad_rate": F.when(exact & has_basis, ratio).when(exact & settled_cad, F.lit(1).cast(RATE)),
            "cad_route": F.when(
                exact & has_basis,
                F.when(bought_cad, F.lit("CAD→CAD")).otherwise(F.concat(cur, F.lit("→CAD"))),
            )
            .when(exact & settled_cad, F.lit("CAD→CAD"))
            .otherwise(F.lit("")),
            "cad_method": F.when(exact & bought_cad, F.lit("statement_purchase_cad"))
            .when(exact & settled_cad, F.lit("statement_exact_cad_settlement"))
            .otherwise(F.lit("")),
            "cad_source": F.when(
                exact & bought_cad, F.concat(provider, F.lit(" statement purchase amount in CAD"))
            )
            .when(exact & settled_cad, F.concat(provider, F.lit(" statement exact CAD settlement")))
            .otherwise(F.lit("")),
            "cad_week_start": F.lit(None).cast("date"),
        }
    )


def apply_weekly_fx(audited: DataFrame, rates: DataFrame) -> DataFrame:
    """CAD2: eligible foreign purchases without CAD get purchase x weekly rate."""
    open_row = (
        F.col("match_eligible")
        & F.col("cad_amount").isNull()
        & F.col("purchase_amount").isNotNull()
        & (F.coalesce(F.col("purchase_currency"), F.lit("")) != "")
        & F.col("transaction_date").isNotNull()
    )
    rated = attach_rates(
        audited.withColumn("_fx_cur", F.when(open_row, F.col("purchase_currency"))),
        rates,
        "_fx_cur",
        "transaction_date",
    )
    hit = open_row & F.col("fx_rate").isNotNull()
    miss = open_row & F.col("fx_rate").isNull()
    note = F.concat(
        F.lit("Weekly CAD conversion unavailable: no "),
        F.col("purchase_currency"),
        F.lit(" rate for the week."),
    )
    cad = (F.col("purchase_amount") * F.col("fx_rate")).cast(MONEY)
    return rated.select(
        *[
            c
            for c in audited.columns
            if c
            not in ("cad_amount", "cad_rate", "cad_route", "cad_method", "cad_source", "cad_week_start", "review_note")
        ],
        F.when(hit, cad).otherwise(F.col("cad_amount")).alias("cad_amount"),
        F.when(hit, F.col("fx_rate")).otherwise(F.col("cad_rate")).alias("cad_rate"),
        F.when(hit, F.col("fx_route")).otherwise(F.col("cad_route")).alias("cad_route"),
        F.when(hit, F.col("fx_method")).otherwise(F.col("cad_method")).alias("cad_method"),
        F.when(hit, F.concat(F.lit("weekly "), F.col("fx_route"), F.lit(" average")))
        .otherwise(F.col("cad_source"))
        .alias("cad_source"),
        F.when(hit, F.col("fx_week_start")).otherwise(F.col("cad_week_start")).alias("cad_week_start"),
        F.when(miss, append_note(F.col("review_note"), note))
        .otherwise(F.col("review_note"))
        .alias("review_note"),
    )


def group_completeness(legs: DataFrame) -> DataFrame:
    """One row per group with its CAD completeness over eligible legs."""
    ok = F.col("match_eligible")
    n, known = F.count_if(ok), F.count_if(ok & F.col("cad_amount").isNotNull())
    return legs.groupBy("trip_id", "group_id").agg(
        F.when(n == 0, F.lit("not_applicable"))
        .when(known == n, F.lit("complete"))
        .when(known > 0, F.lit("partial"))
        .otherwise(F.lit("incomplete"))
        .alias("cad_completeness")
    )


def cad_completeness(legs: DataFrame) -> DataFrame:
    """CAD3: group status written back to its legs (aggregate and join; no per-group window)."""
    joined = legs.drop("cad_completeness").join(group_completeness(legs), ["trip_id", "group_id"])
    lacking = F.col("match_eligible") & F.col("cad_completeness").isin("partial", "incomplete")
    return joined.withColumn(
        "review_note",
        F.when(lacking, append_note(F.col("review_note"), F.lit(NO_CAD_NOTE))).otherwise(
            F.col("review_note")
        ),
    )


# Columns of legs whose different values a group lists in order of first appearance, and how they are joined
LISTED = {"cad_source": "; ", "review_note": " "}


def first_appearances(rows: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """(keys, column, value, first): each different non-empty value of the columns with the least place it has.

    Equal values are combined before the shuffle, so a key with very many rows sends one row a value and task. The
    result is rows, which may be many for a key; ``first`` puts them in order.
    """
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = rows.select(*keys, F.struct(*order).alias("_at"), F.explode(values).alias("v")).filter("coalesce(v.value, '') <> ''")
    return long.groupBy(*keys, F.col("v.column").alias("column"), F.col("v.value").alias("value")).agg(F.min("_at").alias("first"))


def group_lists(legs: DataFrame) -> DataFrame:
    """GRP1: per group the joined conversion sources of its eligible legs and the joined notes of all, each value once."""
    shown = legs.withColumn("cad_source", F.when(F.col("match_eligible"), F.col("cad_source"))) if "cad_source" in legs.columns else legs
    columns = [c for c in LISTED if c in shown.columns]
    found = first_appearances(shown, ["trip_id", "group_id"], columns, ["source_file", "source_row"])
    packed = found.groupBy("trip_id", "group_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("first", "value")))).alias(c) for c in columns]
    )
    return packed.select("trip_id", "group_id", *[F.array_join(F.col(f"{c}.value"), LISTED[c]).alias(c) for c in columns])


def _leg_matches(legs: DataFrame) -> list[Column]:
    """GRP1: match columns of a group whose legs carry a match: the one file, the strongest status, the best confidence."""
    ok = F.col("match_eligible")
    status = F.when(ok, F.col("match_status"))
    has = lambda s: F.bool_or(status == s)
    return [
        only_value(F.col("matched_file"), ok).alias("matched_file"),
        only_value(F.col("suggested_file"), ok).alias("suggested_file"),
        F.when(has("manual"), F.lit("manual")).when(has("auto"), F.lit("auto")).when(has("suggested"), F.lit("suggested"))
        .when(F.bool_or(ok), F.lit("unmatched")).otherwise(F.lit("audit")).alias("match_status"),
        F.coalesce(F.max("match_confidence"), F.lit(0).cast("decimal(6,3)")).alias("match_confidence"),
        F.coalesce(only_value(F.col("review_reason"), ok), F.lit("")).alias("review_reason"),
    ]


def transaction_groups(legs: DataFrame) -> DataFrame:
    """GRP1: one row per (trip, group).

    Every measure is a constant-size aggregate, so it combines map-side. The audit detail of a
    group (rows, files, funding legs) is the legs table itself, keyed by the same columns; it is
    not collected into arrays, whose size would be unbounded. Different sources and notes are listed by
    ``group_lists``; legs that carry a match (matched_file, suggested_file, match_status, match_confidence,
    review_reason) give the group's.
    """
    ok = F.col("match_eligible")
    carried = _leg_matches(legs) if "match_status" in legs.columns else []
    rank = F.struct(F.when(ok, 0).otherwise(1), F.col("source_file"), F.col("source_row"))
    rep = F.min_by(
        F.struct(
            "transaction_date", "provider", "account_label", "description", "transaction_type"
        ),
        rank,
    )
    n, known = F.count_if(ok), F.count_if(ok & F.col("cad_amount").isNotNull())
    eligible_rate = F.when(ok, F.col("cad_rate"))
    base = legs.groupBy("trip_id", "group_id").agg(
        rep.alias("_rep"),
        only_value(F.col("purchase_currency"), ok).alias("purchase_currency"),
        sum_or_null(F.col("purchase_amount"), ok).alias("_purchase"),
        F.when(n == 0, F.lit("not_applicable"))
        .when(known == n, F.lit("complete"))
        .when(known > 0, F.lit("partial"))
        .otherwise(F.lit("incomplete"))
        .alias("cad_completeness"),
        sum_or_null(F.col("cad_amount"), ok).alias("_cad"),
        F.min(eligible_rate).alias("_rate_low"),
        F.max(eligible_rate).alias("_rate_high"),
        one_or_mixed(F.col("cad_method"), ok).alias("cad_method"),
        one_or_mixed(F.col("cad_route"), ok).alias("cad_route"),
        only_value(F.col("cad_week_start"), ok).alias("cad_week_start"),
        (n > 0).alias("match_eligible"),
        F.when(F.max(F.col("normalization_status") == "possible_duplicate"), F.lit("possible_duplicate"))
        .when(F.max(F.col("normalization_status") == "review"), F.lit("review"))
        .otherwise(F.min("normalization_status"))
        .alias("normalization_status"),
        F.bool_and(
            ~ok | F.col("normalization_status").isin("ok", "duplicate_confirmed")
        ).alias("clean_legs"),
        F.count("*").alias("leg_count"),
        *carried,
    )
    purchase = F.when(F.col("purchase_currency").isNotNull(), F.col("_purchase")).cast(MONEY)
    cad = F.when(F.col("cad_completeness") == "complete", F.col("_cad")).cast(MONEY)
    rate = F.when(F.col("_rate_low") == F.col("_rate_high"), F.col("_rate_low")).when(
        cad.isNotNull() & (F.coalesce(purchase, F.lit(0)) != 0),
        (F.abs(cad) / F.abs(purchase)).cast(RATE),
    )
    return base.select(
        "trip_id",
        "group_id",
        "_rep.*",
        purchase.alias("purchase_amount"),
        "purchase_currency",
        cad.alias("cad_amount"),
        "cad_completeness",
        rate.alias("cad_rate"),
        "cad_method",
        "cad_route",
        "cad_week_start",
        F.date_add("cad_week_start", 6).alias("cad_week_end"),
        "match_eligible",
        "normalization_status",
        (F.col("normalization_status") == "possible_duplicate").alias("possible_duplicate"),
        "clean_legs",
        "leg_count",
        *(["matched_file", "suggested_file", "match_status", "match_confidence", "review_reason"] if carried else []),
    )
