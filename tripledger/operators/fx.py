"""Weekly CAD rates (FX1-FX3, FX5) and the receipt estimate (FX4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.amounts import RATE, amount_bucket, close_amount, close_amount_buckets
from tripledger.functions.materialize import grown

QAR_PER_USD = "3.64"  # fixed value: official QAR/USD peg


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def weekly_rates(observations: DataFrame) -> DataFrame:
    """FX1: mean of the daily observations per currency and Monday week.

    observations: currency, obs_date, cad_per_unit. Two partial aggregates instead of one
    collect: sums per day first, so the observation array of a week has at most seven entries
    whatever the input repeats.
    """
    daily = (
        observations.filter(F.col("cad_per_unit").isNotNull())
        .groupBy("currency", "obs_date")
        .agg(
            F.sum("cad_per_unit").alias("_sum"),
            F.count("cad_per_unit").alias("_n"),
        )
        .withColumn("week_start", week_start(F.col("obs_date")))
    )
    day_mean = (F.col("_sum") / F.col("_n")).cast(RATE)
    return (
        daily.groupBy("currency", "week_start")
        .agg(
            (F.sum("_sum") / F.sum("_n")).cast(RATE).alias("cad_per_unit"),
            F.sum("_n").cast("bigint").alias("observation_count"),
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("obs_date").alias("date"), day_mean.alias("cad_per_unit"))
                )
            ).alias("observations"),
        )
        .select(
            "currency",
            "week_start",
            F.date_add("week_start", 6).alias("week_end"),
            "cad_per_unit",
            F.lit("weekly_average_direct").alias("method"),
            F.concat(F.col("currency"), F.lit("→CAD")).alias("route"),
            "observation_count",
            "observations",
        )
    )


def pegged_rates(weekly: DataFrame) -> DataFrame:
    """FX2: QAR from the weekly USD rate through the official peg."""
    return weekly.filter(F.col("currency") == "USD").select(
        F.lit("QAR").alias("currency"),
        "week_start",
        "week_end",
        (F.col("cad_per_unit") / F.lit(QAR_PER_USD).cast("decimal(4,2)")).cast(RATE).alias("cad_per_unit"),
        F.lit("weekly_average_official_peg").alias("method"),
        F.lit("QAR→USD→CAD").alias("route"),
        "observation_count",
        "observations",
    )


def rate_table(observations: DataFrame) -> DataFrame:
    """All weekly rates: direct ones plus the pegged currency (which never uses its own quotes)."""
    direct = weekly_rates(observations).filter(F.col("currency") != "QAR")
    return direct.unionByName(pegged_rates(direct))


def attach_rates(rows: DataFrame, rates: DataFrame, currency: str, day: str) -> DataFrame:
    """Left join of weekly rates by (currency, Monday); CAD resolves to the identity rate (FX3).

    The rate table grows by one row per currency and week (about 8,000 rows for 155 currencies
    and a year), so Spark's own size check decides whether it is broadcast.
    """
    slim = rates.select(
        F.col("currency").alias("_cur"),
        F.col("week_start").alias("_week"),
        F.col("cad_per_unit").alias("_rate"),
        F.col("method").alias("_method"),
        F.col("route").alias("_route"),
    )
    keyed = rows.withColumn("_row_cur", F.upper(F.col(currency))).withColumn(
        "_row_week", week_start(F.col(day))
    )
    is_cad = (F.col("_row_cur") == "CAD") & F.col("_row_week").isNotNull()
    # only rows that need a rate meet the table; the others have no key, or all the same
    asks = F.coalesce((F.col("_row_cur") != "CAD") & F.col("_row_week").isNotNull(), F.lit(False))
    answered = keyed.filter(asks).join(
        slim,
        (F.col("_row_cur") == F.col("_cur")) & (F.col("_row_week") == F.col("_week")),
        "left",
    )
    return (
        answered.unionByName(keyed.filter(~asks), allowMissingColumns=True)
        .withColumn("fx_rate", F.when(is_cad, F.lit(1).cast(RATE)).otherwise(F.col("_rate")))
        .withColumn("fx_method", F.when(is_cad, F.lit("identity")).otherwise(F.col("_method")))
        .withColumn("fx_route", F.when(is_cad, F.lit("CAD→CAD")).otherwise(F.col("_route")))
        .withColumn("fx_week_start", F.when(F.col("fx_rate").isNotNull(), F.col("_row_week")))
        .withColumn("fx_week_end", F.date_add("fx_week_start", 6))
        .drop("_cur", "_week", "_rate", "_method", "_route", "_row_cur", "_row_week")
    )


def missing_rate_keys(needed: DataFrame, stored: DataFrame) -> DataFrame:
    """FX5, first half: (currency, week) pairs asked for and not stored yet."""
    asked = needed.select(
        F.upper("currency").alias("currency"), week_start(F.col("day")).alias("week_start")
    ).distinct()
    return asked.filter("currency <> 'CAD' and week_start is not null").join(
        stored.select("currency", "week_start"), ["currency", "week_start"], "left_anti"
    )


def merge_rate_cache(stored: DataFrame, needed: DataFrame, observations: DataFrame) -> DataFrame:
    """FX5: stored rates stay as they are; only missing pairs are computed and appended."""
    fresh = rate_table(observations).join(
        missing_rate_keys(needed, stored), ["currency", "week_start"], "left_semi"
    )
    return stored.unionByName(fresh.select(*stored.columns))


def estimate_receipt_cad(receipts: DataFrame, groups: DataFrame, rates: DataFrame) -> DataFrame:
    """FX4: estimated CAD of receipts that have no exact card row but a CAD row nearby.

    receipts: trip_id, source_file, receipt_date, currency, share; groups: eligible card rows
    with transaction_date, purchase_amount, purchase_currency, cad_amount. Both conditions are
    existence tests, so each side is reduced to distinct keys and joined by equality: amounts
    through logarithmic buckets, the seven-day band through exploded days.
    """
    asked = receipts.filter(
        F.col("receipt_date").isNotNull()
        & F.col("share").isNotNull()
        & (F.coalesce(F.col("currency"), F.lit("")) != "")
    ).withColumn("currency", F.upper("currency"))
    want = (
        asked.select("trip_id", "currency", "share")
        .distinct()
        .withColumn("_bucket", F.explode(close_amount_buckets(F.col("share"))))
    )
    have = (
        groups.filter(F.col("purchase_amount").isNotNull())
        .select(
            "trip_id",
            F.upper("purchase_currency").alias("currency"),
            F.abs("purchase_amount").alias("_amount"),
        )
        .distinct()
        .withColumn("_bucket", amount_bucket(F.col("_amount")))
    )
    exact = (
        want.join(grown(have), ["trip_id", "currency", "_bucket"])
        .filter(close_amount(F.col("share"), F.col("_amount")))
        .select("trip_id", "currency", "share")
        .distinct()
    )
    # Fifteen-day blocks: a date within seven days of a row lies in one of the two blocks of that row.
    block = lambda day: F.floor(F.unix_date(day) / F.lit(15)).cast("int")
    cad_days = (
        groups.filter(F.col("cad_amount").isNotNull() & F.col("transaction_date").isNotNull())
        .select("trip_id", "transaction_date")
        .distinct()
        .withColumn(
            "_block",
            F.explode(
                F.array_distinct(
                    F.array(block(F.date_sub("transaction_date", 7)), block(F.date_add("transaction_date", 7)))
                )
            ),
        )
        .alias("d")
    )
    unmatched = (
        asked.join(grown(exact), ["trip_id", "currency", "share"], "left_anti")
        .withColumn("_block", block(F.col("receipt_date")))
        .alias("r")
    )
    open_receipts = unmatched.join(
        grown(cad_days),
        (F.col("r.trip_id") == F.col("d.trip_id"))
        & (F.col("r._block") == F.col("d._block"))
        & (F.abs(F.date_diff(F.col("r.receipt_date"), F.col("d.transaction_date"))) <= 7),
        "left_semi",
    ).drop("_block")
    return (
        attach_rates(open_receipts, rates, "currency", "receipt_date")
        .filter(F.col("fx_rate").isNotNull())
        .select(
            "trip_id",
            "source_file",
            "currency",
            "share",
            "fx_rate",
            (F.col("share") * F.col("fx_rate")).cast("decimal(18,2)").alias("estimated_cad"),
        )
    )
