"""Money and date-distance predicates as Column expressions (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
SHARE = "decimal(22,6)"  # a share of any money amount
RATE = "decimal(20,10)"


def lit_dec(value: str, kind: str = "decimal(10,4)") -> Column:
    return F.lit(value).cast(kind)


def round_money(value: Column) -> Column:
    return value.cast(MONEY)


def cents(value: Column) -> Column:
    return (value.cast(MONEY) * 100).cast("decimal(18,0)")


def part_of(amount: Column, part: Column, whole: Column, people: Column | None = None) -> Column:
    """amount * part / whole (/ people), rounded once, half up: exact in whole cents for every money amount with part <= whole."""
    below = cents(whole) if people is None else cents(whole) * people.cast("decimal(6,0)")
    rounded = F.call_function("div", 2 * F.abs(cents(amount)) * F.abs(cents(part)) + below, F.nullif(2 * below, F.lit(0)))
    sign = (F.signum(amount) * F.signum(part)).cast("decimal(1,0)")
    return (sign * rounded.cast("decimal(18,0)") * lit_dec("0.01", "decimal(2,2)")).cast(MONEY)


def at_rate(amount: Column, rate: Column, ratio: Column | None = None) -> Column:
    """amount * rate (* ratio of at most 1) in cents; null where that is beyond a money column.

    Amounts and rates of usual size are multiplied without any loss; larger ones with six digits behind the point.
    """
    exact = amount.try_cast("decimal(12,2)") * rate.try_cast("decimal(12,6)")
    large = F.try_multiply(amount.cast(MONEY), rate.cast(SHARE))
    if ratio is not None:
        exact, large = exact * ratio.cast("decimal(10,8)"), F.try_multiply(large.try_cast("decimal(27,6)"), ratio.cast("decimal(10,8)"))
    return F.coalesce(exact.try_cast(MONEY), large.try_cast(MONEY))


def close_amount(left: Column, right: Column) -> Column:
    """|left-right| within 1.5 % of the first argument, at least 3 cents."""
    return F.abs(left - right) <= F.greatest(lit_dec("0.03"), F.abs(left) * lit_dec("0.015", "decimal(4,3)"))


def close_fx_amount(estimate: Column, settled: Column) -> Column:
    """Weekly-rate estimate against settled CAD: 6 % of the estimate, at least 50 cents."""
    return F.abs(estimate - settled) <= F.greatest(
        lit_dec("0.50"), F.abs(estimate) * lit_dec("0.06", "decimal(4,2)")
    )


def has_card_gap(receipt: Column, card: Column) -> Column:
    """Receipt is 68-95 % of the card total: plausibly tax or tip was added at the till."""
    r, c = F.abs(receipt), F.abs(card)
    return F.coalesce(
        (r > 0) & (c > r) & (r >= c * lit_dec("0.68", "decimal(3,2)")) & (r <= c * lit_dec("0.95", "decimal(3,2)")),
        F.lit(False),
    )


def card_gap_percent(receipt: Column, card: Column) -> Column:
    r, c = F.abs(receipt).cast("double"), F.abs(card).cast("double")
    return F.when(has_card_gap(receipt, card), F.bround((F.lit(1.0) - r / c) * 100).cast("int"))


def split_people(receipt: Column, card: Column) -> Column:
    """Number of people (2..12) a receipt would be split by to give the card amount, else null."""
    ratio = receipt.cast("double") / F.nullif(card.cast("double"), F.lit(0.0))
    n = F.bround(ratio).cast("int")
    ok = (card > 0) & (receipt > card) & n.between(2, 12) & (F.abs(ratio - n) <= 0.08)
    return F.when(F.coalesce(ok, F.lit(False)), n)


def per_person_share(amount: Column, people: Column) -> Column:
    n = F.greatest(F.lit(1), F.coalesce(people, F.lit(1)))
    return (F.abs(amount).cast(SHARE) / n.cast("decimal(6,0)")).cast(SHARE)


def days_apart(left: Column, right: Column) -> Column:
    return F.abs(F.date_diff(left, right))


def amounts_align(actual: Column, expected: Column) -> Column:
    """Within 8 % of the expected amount, at least 2.00."""
    return F.abs(actual - expected) <= F.greatest(
        lit_dec("2.00"), F.abs(expected) * lit_dec("0.08", "decimal(3,2)")
    )


def includes_tip(actual: Column, expected: Column) -> Column:
    """Above the alignment band but at most 35 % over the expected amount."""
    band = F.greatest(lit_dec("2.00"), F.abs(expected) * lit_dec("0.08", "decimal(3,2)"))
    return (actual > expected + band) & (actual <= expected * lit_dec("1.35", "decimal(3,2)"))


LN_BUCKET = math.log(1.1)


def amount_bucket(value: Column) -> Column:
    """Logarithmic bucket, 10 % wide. Monotone, so an amount interval maps to a run of buckets."""
    return F.floor(F.ln(F.greatest(value.cast("double"), F.lit(0.01))) / F.lit(LN_BUCKET)).cast("int")


def bucket_run(low: Column, high: Column) -> Column:
    return F.sequence(amount_bucket(low), amount_bucket(high))


def close_amount_buckets(value: Column) -> Column:
    """Buckets that hold every amount ``close_amount`` accepts for ``value`` on either side."""
    v = value.cast("double")
    return bucket_run(F.least(v * 0.98, v - 0.04), F.greatest(v * 1.02, v + 0.04))


def close_fx_buckets(value: Column) -> Column:
    """Buckets of every estimate ``close_fx_amount`` accepts for the settled amount ``value``."""
    v = value.cast("double")
    return bucket_run(F.least(v * 0.93, v - 0.51), F.greatest(v * 1.07, v + 0.51))


def receipt_buckets_for_card(card: Column) -> Column:
    """Buckets of the receipt amounts that a card amount can be close to or exceed by tax and tip."""
    v = card.cast("double")
    return bucket_run(F.least(v * 0.67, v - 0.04), F.greatest(v * 1.02, v + 0.04))
