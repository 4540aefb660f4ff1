"""Receipt lines, tax rows and totals (TXT18, LIN1-LIN9, ALC1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.amounts import MONEY, SHARE, lit_dec

RECEIPT = ["trip_id", "source_file"]
# Fixed values
TAX_LABELS = {"gst_hst": "GST/HST", "qst": "QST"}
GST_NAMES = ["GST", "HST", "GST HST", "TPS", "TVH", "TPS TVH"]
QST_NAMES = ["QST", "TVQ"]
EXCLUSION_REASONS = ["alcohol", "non_business", "policy_cap", "missing_documentation", "other"]
ALCOHOL_PLACEHOLDER = "Alcohol adjustment - manual"
UNRECONCILED_MEAL = "Unreconciled meal item - review"
TAX_POSITION = 9_000_000_000_000_000_000  # tax rows sort after every extracted line


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def tax_line_type(description: Column) -> Column:
    """TXT18."""
    label = F.trim(F.regexp_replace(F.upper(F.coalesce(description, F.lit(""))), "[^A-Z]+", " "))
    return F.when(label.isin(GST_NAMES), F.lit("gst_hst")).when(label.isin(QST_NAMES), F.lit("qst"))


def is_meal(expense_type: Column) -> Column:
    return F.coalesce(expense_type.startswith("meal"), F.lit(False))


def tax_rows(receipts: DataFrame) -> DataFrame:
    """The two system rows of each receipt from its gst_hst and qst columns."""
    rows = F.array(
        *[
            F.struct(
                F.lit(TAX_POSITION + i).cast("bigint").alias("pos"),
                F.lit(label).alias("description"),
                F.coalesce(F.col(kind), _zero()).try_cast(MONEY).alias("amount"),
                F.lit(kind).alias("line_type"),
            )
            for i, (kind, label) in enumerate(TAX_LABELS.items())
        ]
    )
    return receipts.select(*RECEIPT, F.explode(rows).alias("t")).select(
        *RECEIPT,
        "t.*",
        F.lit(False).alias("is_alcohol"),
        F.lit(1.0).cast("double").alias("confidence"),
        F.lit(True).alias("synthetic"),
    )


def canonical_tax_lines(lines: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LIN1: (receipts with settled tax fields, ordinary lines + exactly two tax rows).

    A structured receipt field beats the first tax-like line. The first line per kind is a
    min_by aggregate, so the lines are shuffled once and no receipt is gathered.
    """
    kind = F.coalesce(
        F.when(F.col("line_type").isin(list(TAX_LABELS)), F.col("line_type")), tax_line_type(F.col("description"))
    )
    tagged = lines.withColumn("_kind", kind)
    found = (
        tagged.filter("_kind is not null")
        .groupBy(*RECEIPT)
        .agg(
            *[
                F.min_by(
                    F.when(F.col("_kind") == k, F.col("amount")), F.when(F.col("_kind") == k, F.col("pos"))
                ).alias(f"_{k}")
                for k in TAX_LABELS
            ]
        )
    )
    settled = receipts.join(found, RECEIPT, "left")
    settled = settled.select(
        *[c for c in receipts.columns if c not in TAX_LABELS],
        *[F.coalesce(F.col(k), F.col(f"_{k}"), _zero()).try_cast(MONEY).alias(k) for k in TAX_LABELS],
    )
    ordinary = tagged.filter("_kind is null").select(
        *RECEIPT, "pos", "description", "amount", F.lit("item").alias("line_type"), "is_alcohol", "confidence",
        F.coalesce(F.col("synthetic"), F.lit(False)).alias("synthetic") if "synthetic" in lines.columns else F.lit(False).alias("synthetic"),
    )
    return settled, ordinary.unionByName(tax_rows(settled))


def _line_sums(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*RECEIPT).agg(
        F.coalesce(F.sum("amount"), _zero()).try_cast(MONEY).alias("_total"),
        F.count_if(~F.col("line_type").isin(list(TAX_LABELS))).alias("_ordinary"),
        F.bool_or(F.col("description").startswith("Receipt total")).alias("_has_total"),
        F.bool_or(F.col("description") == UNRECONCILED_MEAL).alias("_has_gap"),
    )


def gap_line(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """LIN2: one balancing row where the lines stay below the receipt total.

    Meals: gap over .05 becomes ``Tip``. Other types: gap over max(.05, 3 %) becomes ``Receipt
    subtotal`` when it equals the subtotal or no purchase line exists, else a row to review.
    """
    j = receipts.join(_line_sums(lines), RECEIPT, "left").filter("amount is not null")
    total = F.coalesce("_total", _zero())
    gap = (F.col("amount") - total).try_cast(MONEY)
    meal = is_meal(F.col("expense_type"))
    blocked = F.coalesce(F.col("_has_total"), F.lit(False)) | F.coalesce(F.col("_has_gap"), F.lit(False))
    matches = F.coalesce(F.abs(F.col("subtotal") - gap) <= lit_dec("0.05"), F.lit(False))
    bare = F.coalesce("_ordinary", F.lit(0)) == 0
    wanted = F.when(meal, (gap > lit_dec("0.05")) & ~blocked).otherwise(
        gap > F.greatest(lit_dec("0.05"), F.abs("amount") * lit_dec("0.03", "decimal(3,2)"))
    )
    return j.filter(wanted).select(
        *RECEIPT,
        F.lit(TAX_POSITION - 1).cast("bigint").alias("pos"),
        F.when(meal, F.lit("Tip"))
        .when(matches | bare, F.lit("Receipt subtotal"))
        .otherwise(F.lit("Unreconciled receipt item - review"))
        .alias("description"),
        gap.alias("amount"),
        F.lit("item").alias("line_type"),
        F.lit(False).alias("is_alcohol"),
        F.when(meal, 0.5).when(matches, 0.9).otherwise(0.5).cast("double").alias("confidence"),
        F.lit(True).alias("synthetic"),
    )


def minimum_lines(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """LIN3: a single total row for receipts without any line (anti join), plus alcohol placeholders."""
    meal = is_meal(F.col("expense_type"))
    missing = F.col("amount").isNull()
    empty = receipts.join(lines.select(*RECEIPT), RECEIPT, "left_anti")
    return empty.select(
        *RECEIPT,
        F.lit(1).cast("bigint").alias("pos"),
        F.when(missing, F.lit("Receipt total missing - review"))
        .when(meal, F.lit("Receipt total - review meal line items"))
        .otherwise(F.lit("Receipt total"))
        .alias("description"),
        F.col("amount").try_cast(MONEY).alias("amount"),
        F.lit("item").alias("line_type"),
        F.lit(False).alias("is_alcohol"),
        F.when(missing, 0.0).otherwise(0.5).cast("double").alias("confidence"),
        F.lit(True).alias("synthetic"),
    )


def alcohol_placeholder(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """LIN3: zero row that a reviewer can fill, where none exists yet."""
    have = lines.filter(F.col("description") == ALCOHOL_PLACEHOLDER).select(*RECEIPT)
    return receipts.join(have, RECEIPT, "left_anti").select(
        *RECEIPT,
        F.lit(TAX_POSITION + 2).cast("bigint").alias("pos"),
        F.lit(ALCOHOL_PLACEHOLDER).alias("description"),
        _zero().alias("amount"),
        F.lit("item").alias("line_type"),
        F.lit(True).alias("is_alcohol"),
        F.lit(1.0).cast("double").alias("confidence"),
        F.lit(True).alias("synthetic"),
    )


def reconcile_note(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """LIN4: note per meal receipt whose lines do not add up to its total."""
    counted = (
        F.col("amount").isNotNull()
        & ~F.col("description").startswith("Receipt total")
        & (F.col("description") != ALCOHOL_PLACEHOLDER)
    )
    sums = lines.groupBy(*RECEIPT).agg(
        F.sum(F.when(counted, F.col("amount"))).try_cast(MONEY).alias("_sum"),
        F.bool_or(F.col("description") == UNRECONCILED_MEAL).alias("_gap"),
    )
    j = receipts.join(sums, RECEIPT, "left")
    off = F.abs(F.col("_sum") - F.col("amount")) > F.greatest(
        lit_dec("0.05"), F.col("amount") * lit_dec("0.03", "decimal(3,2)")
    )
    note = (
        F.when(
            F.coalesce("_gap", F.lit(False)),
            F.lit("Unreconciled meal item line added to balance receipt total; review description/alcohol manually."),
        )
        .when(~is_meal(F.col("expense_type")), F.lit(""))
        .when(F.col("amount").isNull(), F.lit("Missing receipt total; review manually."))
        .when(F.col("_sum").isNull(), F.lit("No reliable meal line items extracted; review alcohol manually."))
        .when(
            off,
            F.concat(
                F.lit("Line items total "), F.col("_sum").cast("string"),
                F.lit(" differs from receipt total "), F.col("amount").cast("string"),
                F.lit("; review line items/alcohol."),
            ),
        )
        .otherwise(F.lit(""))
    )
    return j.select(*RECEIPT, note.alias("note"))


def line_signature() -> Column:
    text = F.regexp_replace(F.trim(F.lower(F.coalesce("description", F.lit("")))), r"\s+", " ")
    return F.concat(text, F.lit("|"), F.coalesce(F.col("amount").try_cast(MONEY).cast("string"), F.lit("")))


def line_ids(lines: DataFrame, written: bool = False) -> DataFrame:
    """LIN5: stable line id from file, description, amount and occurrence.

    The occurrence number uses ``positions_within``, so equal lines of any number are numbered
    without gathering them. written: the lines are a written table, which is not written again.
    """
    from tripledger.functions.ranking import positions_within

    numbered = positions_within(lines.withColumn("_sig", line_signature()), [*RECEIPT, "_sig"], ["pos"], written=written)
    tax = F.col("line_type").isin(list(TAX_LABELS))
    payload = F.when(tax, F.concat_ws("|", "source_file", F.lit("system-tax"), "line_type")).otherwise(
        F.concat_ws("|", "source_file", "_sig", F.col("position").cast("string"))
    )
    return numbered.withColumn(
        "line_id", F.concat(F.lit("LI-"), F.left(F.sha2(payload, 256), F.lit(16)))
    ).drop("_sig", "position")


def receipt_id() -> Column:
    raw = F.concat(F.col("trip_id"), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.col("source_file"))
    return F.concat(F.lit("RCPT-"), F.left(F.sha2(raw, 256), F.lit(20)))


def program_inclusion(lines: DataFrame) -> DataFrame:
    """LIN6: company always in; alcohol out of the sponsor's share; other exclusions need a reason."""
    stored_in = F.coalesce(F.col("in_sponsor"), F.lit(True)) if "in_sponsor" in lines.columns else F.lit(True)
    stored_reason = F.col("exclusion_reason") if "exclusion_reason" in lines.columns else F.lit(None).cast("string")
    alcohol = F.coalesce("is_alcohol", F.lit(False))
    stale = F.coalesce(stored_reason == "alcohol", F.lit(False))
    return lines.withColumns(
        {
            "in_company": F.lit(True),
            "in_sponsor": ~alcohol & (stored_in | stale),
            "exclusion_reason": F.when(alcohol, F.lit("alcohol"))
            .when(stale | stored_in, F.lit(None))
            .otherwise(F.coalesce(F.nullif(stored_reason, F.lit("")), F.lit("other"))),
        }
    )


def receipt_totals(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """LIN7: totals per receipt and programme (one aggregate of conditional sums)."""
    company = F.col("in_company")
    sponsor = F.col("in_company") & F.col("in_sponsor")
    sums = lines.groupBy(*RECEIPT).agg(
        F.coalesce(F.sum("amount"), _zero()).try_cast(MONEY).alias("line_total"),
        F.coalesce(F.sum(F.when(company, F.col("amount"))), _zero()).try_cast(MONEY).alias("company_included_total"),
        F.coalesce(F.sum(F.when(sponsor, F.col("amount"))), _zero()).try_cast(MONEY).alias("sponsor_included_total"),
        F.bool_or(F.col("description") == UNRECONCILED_MEAL).alias("has_gap_line"),
    )
    j = receipts.join(sums, RECEIPT, "left")
    total = F.coalesce("line_total", _zero())
    comp = F.coalesce("company_included_total", _zero())
    spon = F.coalesce("sponsor_included_total", _zero())
    people = F.greatest(F.lit(1), F.coalesce("number_of_people", F.lit(1)))
    sponsored = F.col("claim_program") == "sponsored" if "claim_program" in receipts.columns else F.lit(False)
    included = F.when(sponsored, spon).otherwise(comp)
    difference = (total - F.col("amount")).try_cast(MONEY)
    reconciled = F.coalesce(difference == 0, F.lit(False))
    meal = is_meal(F.col("expense_type"))
    has_gap = F.coalesce("has_gap_line", F.lit(False))
    excluded = (total - included).try_cast(MONEY)
    cut = excluded > lit_dec("0.005")

    def share(value: Column) -> Column:
        return (value.cast(SHARE) / people.cast("decimal(6,0)")).try_cast(MONEY)

    return j.select(
        *receipts.columns,
        total.alias("line_total"),
        comp.alias("company_included_total"),
        (total - comp).try_cast(MONEY).alias("company_excluded_total"),
        spon.alias("sponsor_included_total"),
        (comp - spon).try_cast(MONEY).alias("sponsor_excluded_total"),
        difference.alias("difference"),
        reconciled.alias("reconciled"),
        F.when(~reconciled | has_gap, F.lit("review"))
        .when(~meal, F.lit("not_applicable"))
        .otherwise(F.lit("ok"))
        .alias("automatic_status"),
        (meal & cut & (~reconciled | has_gap)).alias("blocking"),
        share(F.col("amount")).alias("per_person_total"),
        share(comp).alias("per_person_company_total"),
        share(spon).alias("per_person_sponsor_total"),
        F.when(
            cut & reconciled & (total > 0),
            F.greatest(F.lit(0), F.least(F.lit(1), included.try_cast(MONEY) / total.try_cast(MONEY))).cast("decimal(10,8)"),
        )
        .otherwise(F.lit(1).cast("decimal(10,8)"))
        .alias("claimable_ratio"),
    )


def sponsor_amounts(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """LIN8: original claim and the removed alcohol / other shares per receipt."""
    out = F.col("in_company") & ~F.col("in_sponsor")
    kept = F.col("in_company") & F.col("in_sponsor")
    alcohol = F.coalesce("is_alcohol", F.lit(False))
    sums = lines.groupBy(*RECEIPT).agg(
        F.bool_or(out).alias("_any"),
        F.coalesce(F.sum(F.when(kept, F.col("amount"))), _zero()).alias("_kept"),
        F.coalesce(F.sum(F.when(out & alcohol, F.col("amount"))), _zero()).alias("_alc"),
        F.coalesce(F.sum(F.when(out & ~alcohol, F.col("amount"))), _zero()).alias("_oth"),
    )
    people = F.greatest(F.lit(1), F.coalesce("number_of_people", F.lit(1))).cast("decimal(6,0)")
    whole = F.col("in_company") & ~F.col("in_sponsor")

    def share(value: Column) -> Column:
        return (F.coalesce(value, _zero()).cast(SHARE) / people).try_cast(MONEY)

    j = receipts.join(sums, RECEIPT, "left")
    return j.select(
        *RECEIPT,
        F.when(F.coalesce(F.col("_any") & (F.col("_kept") > 0), F.lit(False)), share(F.col("_kept")))
        .otherwise(share(F.col("amount")))
        .alias("original_claim"),
        F.when(whole, _zero()).otherwise(share(F.col("_alc"))).alias("removed_alcohol"),
        F.when(whole, share(F.col("amount"))).otherwise(share(F.col("_oth"))).alias("removed_other"),
    )


def tax_documentation(receipts: DataFrame) -> DataFrame:
    """LIN9: missing tax numbers from 100, missing purchaser, terms or description from 500 (CAD)."""
    total = F.coalesce("amount", _zero())

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    def warn(when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(text))

    cad500 = (F.col("currency") == "CAD") & (total >= 500)
    warnings = F.array_compact(
        F.array(
            warn((total >= 100) & (F.coalesce("gst_hst", _zero()) > 0) & blank("gst_hst_number"), "GST/HST number missing"),
            warn((total >= 100) & (F.coalesce("qst", _zero()) > 0) & blank("qst_number"), "QST number missing"),
            warn(cad500 & blank("purchaser_name"), "purchaser name missing"),
            warn(cad500 & blank("payment_terms"), "payment terms missing"),
            warn(cad500 & blank("description"), "expense description missing"),
        )
    )
    country = F.coalesce("country", F.lit(""))
    abroad = (country != "") & (country != "Canada")
    some = F.size(warnings) > 0
    return receipts.withColumns(
        {
            "tax_documentation_status": F.when(abroad, F.lit("not_applicable"))
            .when(some, F.lit("review"))
            .when((country == "Canada") | F.coalesce(F.col("currency") == "CAD", F.lit(False)), F.lit("ok"))
            .otherwise(F.lit("not_applicable")),
            "tax_documentation_note": F.when(
                ~abroad & some, F.concat(F.lit("Tax documentation: "), F.array_join(warnings, "; "), F.lit("."))
            ).otherwise(F.lit("")),
        }
    )


def prorate_money(
    rows: DataFrame, keys: Sequence[str], total: str, weight: str, order: Sequence[str], out: str
) -> DataFrame:
    """ALC1: split ``total`` of a key over its rows by weight, to the cent.

    Rounded shares, the residual on the last row; all on the first row when no weight is
    positive. Sums and first/last rows are aggregates joined back, not a per-key window.
    """
    w = F.greatest(F.lit(0), F.coalesce(F.col(weight), F.lit(0))).try_cast(MONEY)
    cents = lambda c: (c.try_cast(MONEY) * 100).cast("decimal(18,0)")
    place = F.struct(*order)
    sums = rows.groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.max(place).alias("_last"), F.min(place).alias("_first")
    )
    # whole cents, half up: exact for every amount that a money column holds
    whole = (F.col("_w") * 100).cast("decimal(26,0)")
    rounded = F.call_function("div", 2 * F.abs(cents(F.col(total))) * cents(w) + whole, 2 * whole)
    share = F.when(
        F.col("_w") <= 0, F.when(place == F.col("_first"), F.col(total)).otherwise(_zero())
    ).otherwise((F.signum(F.col(total)).cast("decimal(1,0)") * rounded.cast("decimal(18,0)") * lit_dec("0.01", "decimal(2,2)")).try_cast(MONEY))
    shared = rows.join(sums, list(keys)).withColumn("_share", share.try_cast(MONEY))
    given = shared.groupBy(*keys).agg(F.sum("_share").alias("_given"))
    residual = F.when((place == F.col("_last")) & (F.col("_w") > 0), F.col(total) - F.col("_given")).otherwise(_zero())
    return (
        shared.join(given, list(keys))
        .withColumn(out, (F.col("_share") + residual).try_cast(MONEY))
        .drop("_w", "_last", "_first", "_share", "_given")
    )
