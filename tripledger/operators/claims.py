"""CAD basis of receipts, claim amounts, journal and controls (CLM1-CLM12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.functions.amounts import MONEY, amounts_align, at_rate, includes_tip, lit_dec, part_of
from tripledger.operators.decisions import REIMBURSABLE_TYPES
from tripledger.operators.lines import is_meal

RECEIPT = ["trip_id", "source_file"]
FX6 = "decimal(22,6)"
POSTED = "decimal(26,8)"
STATEMENT_SOURCES = ["statement", "statement_aggregated", "allocation", "allocation_aggregated"]  # fixed values
CONTROL_TOLERANCE = "0.02"  # fixed value


def _zero(kind: str = MONEY) -> Column:
    return F.lit(0).cast(kind)


def people_of(column: str = "number_of_people") -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.col(column), F.lit(1)))


def receipt_cad_totals(groups: DataFrame, allocations: DataFrame, receipts: DataFrame) -> DataFrame:
    """CLM1: CAD and purchase sums per receipt over direct matches and balanced allocations.

    groups carry matched_file, ignored, allocation_status. Both inputs become one narrow table of
    contributions, aggregated once by receipt.
    """
    known = receipts.select(*RECEIPT)
    complete = (F.col("cad_completeness") == "complete") & F.col("cad_amount").isNotNull()
    bought = (F.coalesce("purchase_amount", _zero()) != 0) & (F.coalesce("purchase_currency", F.lit("")) != "")
    direct = (
        groups.filter((F.col("allocation_status") == "none") & ~F.col("ignored") & F.col("matched_file").isNotNull())
        .select(
            "trip_id",
            F.col("matched_file").alias("source_file"),
            F.when(complete, F.col("cad_amount")).alias("cad"),
            F.when(complete & bought, F.abs("purchase_amount")).alias("purchase"),
            F.when(complete & bought, F.upper("purchase_currency")).alias("currency"),
            (~complete).alias("incomplete"),
            F.lit(False).alias("allocated"),
            F.lit(True).alias("usable"),
        )
    )
    parts = allocations.filter(F.col("type").isin(REIMBURSABLE_TYPES) & F.col("source_file").isNotNull())
    live = parts.join(known, RECEIPT, "left_semi")
    sole = live.groupBy("trip_id", "group_id").agg(F.count("*").alias("_parts"))
    g = groups.filter("allocation_status = 'balanced'").select(
        "trip_id", "group_id", "purchase_amount", "purchase_currency"
    )
    original = F.coalesce(
        F.col("original_amount"), F.when(F.col("_parts") == 1, F.col("purchase_amount"))
    )
    has_original = (F.coalesce(original, _zero()) != 0) & (F.coalesce("purchase_currency", F.lit("")) != "")
    split = (
        live.join(g, ["trip_id", "group_id"])
        .join(sole, ["trip_id", "group_id"])
        .select(
            "trip_id",
            "source_file",
            F.coalesce("cad_amount", _zero()).alias("cad"),
            F.when(has_original, F.abs(original)).alias("purchase"),
            F.when(has_original, F.upper("purchase_currency")).alias("currency"),
            F.lit(False).alias("incomplete"),
            F.lit(True).alias("allocated"),
            F.lit(True).alias("usable"),
        )
    )
    totals = (
        direct.unionByName(split)
        .groupBy(*RECEIPT)
        .agg(
            F.sum("cad").try_cast(MONEY).alias("cad_total"),
            F.sum("purchase").try_cast(FX6).alias("_purchase"),
            F.min("currency").alias("_cur_low"),
            F.max("currency").alias("_cur_high"),
            # a sum beyond a money column is as good as unknown
            (F.bool_or("incomplete") | (F.sum("cad").isNotNull() & F.sum("cad").try_cast(MONEY).isNull())).alias("incomplete"),
            F.bool_or("allocated").alias("allocated"),
            F.count("*").alias("group_count"),
        )
    )
    one = F.col("_cur_low") == F.col("_cur_high")
    return totals.join(known, RECEIPT, "left_semi").select(
        *RECEIPT,
        F.coalesce("cad_total", _zero()).alias("cad_total"),
        F.when(one, F.col("_purchase")).alias("statement_purchase_amount"),
        F.when(one, F.col("_cur_low")).alias("statement_purchase_currency"),
        "incomplete",
        "allocated",
        "group_count",
    )


def cad_source(receipts: DataFrame, totals: DataFrame) -> DataFrame:
    """CLM2: manual, then complete statement or allocation sums, then a CAD receipt, else unavailable."""
    j = receipts.join(totals, RECEIPT, "left")
    matched = F.col("group_count").isNotNull()
    complete = matched & ~F.coalesce("incomplete", F.lit(False))
    many = F.coalesce("group_count", F.lit(0)) > 1
    kind = F.when(
        F.col("allocated"), F.when(many, F.lit("allocation_aggregated")).otherwise(F.lit("allocation"))
    ).otherwise(F.when(many, F.lit("statement_aggregated")).otherwise(F.lit("statement")))
    invoice = (F.col("currency") == "CAD") & ~matched
    return j.withColumns(
        {
            "cad_amount_used": F.when(F.col("manual_cad").isNotNull(), F.col("manual_cad"))
            .when(complete, F.col("cad_total"))
            .when(invoice, F.col("amount")),
            "cad_source": F.when(F.col("manual_cad").isNotNull(), F.lit("manual"))
            .when(complete, kind)
            .when(invoice, F.lit("invoice"))
            .otherwise(F.lit("unavailable")),
            "group_count": F.coalesce("group_count", F.lit(0).cast("bigint")),
        }
    )


def accounting_basis(
    amount: Column, currency: Column, people: Column, statement: Column, statement_currency: Column, aggregated: Column
) -> Column:
    """CLM3: struct(amount, status) - the original-currency denominator of the accounting rate."""
    receipt = F.abs(amount).try_cast(FX6)
    card = F.abs(statement).try_cast(FX6)
    share = (receipt / people.cast("decimal(6,0)")).try_cast(FX6)
    same = F.coalesce(F.upper(statement_currency) == F.upper(F.coalesce(currency, F.lit(""))), F.lit(False)) & (
        F.coalesce(statement_currency, F.lit("")) != ""
    )

    def pick(value: Column, status: str) -> Column:
        return F.struct(value.alias("amount"), F.lit(status).alias("status"))

    return (
        F.when(F.coalesce(amount, _zero()) == 0, pick(F.lit(None).cast(FX6), "unavailable"))
        .when(F.coalesce(statement, _zero()) == 0, pick(receipt, "receipt_total"))
        .when(~same, pick(receipt, "receipt_fallback_currency"))
        .when(aggregated, pick(card, "statement_aggregated"))
        .when(amounts_align(card, receipt), pick(card, "statement_receipt_total"))
        .when(includes_tip(card, receipt), pick(card, "statement_includes_tip"))
        .when((people > 1) & amounts_align(card, share), pick(card, "statement_person_share"))
        .when((people > 1) & includes_tip(card, share), pick(card, "statement_person_share_includes_tip"))
        .otherwise(pick(receipt, "receipt_fallback_mismatch"))
    )


def reconciled_receipts(sourced: DataFrame) -> DataFrame:
    """CLM3 + CLM4: basis, rate and visible difference of receipts that carry CLM2 columns.

    An ``explicit_basis`` column (DEC6) overrides the inferred one.
    """
    people = people_of()
    from_statement = F.col("cad_source").isin(STATEMENT_SOURCES)
    inferred = accounting_basis(
        F.col("amount"),
        F.col("currency"),
        people,
        F.when(from_statement, F.col("statement_purchase_amount")),
        F.col("statement_purchase_currency"),
        F.col("group_count") > 1,
    )
    explicit = (
        from_statement & F.col("explicit_basis").isNotNull() & (F.coalesce("amount", _zero()) != 0)
        if "explicit_basis" in sourced.columns
        else F.lit(False)
    )
    chosen = F.col("explicit_basis") if "explicit_basis" in sourced.columns else F.lit(None).cast("string")
    divisor = F.when(chosen == "personal_share", people).otherwise(F.lit(1)).cast("decimal(6,0)")
    out = sourced.withColumn("_b", inferred).withColumns(
        {
            "fx_basis_amount": F.when(explicit, (F.abs("amount").try_cast(FX6) / divisor).try_cast(FX6)).otherwise(
                F.col("_b.amount")
            ),
            "_status": F.when(explicit, F.concat(F.lit("statement_"), chosen, F.lit("_explicit"))).otherwise(
                F.col("_b.status")
            ),
        }
    )
    personal = ["statement_person_share", "statement_person_share_includes_tip", "statement_personal_share_explicit"]
    same = F.upper(F.coalesce("currency", F.lit(""))) == F.upper(F.coalesce("statement_purchase_currency", F.lit("")))
    expected = F.when(
        F.col("_status").isin(personal[:2]) | ((F.col("_status") == "receipt_fallback_mismatch") & (people > 1)),
        (F.abs("amount").try_cast(FX6) / people.cast("decimal(6,0)")).try_cast(FX6),
    ).otherwise(F.abs("amount").try_cast(FX6))
    shown = (
        (F.col("_status") != "statement_aggregated")
        & (F.coalesce("amount", _zero()) != 0)
        & F.col("statement_purchase_amount").isNotNull()
        & same
        & (F.coalesce("currency", F.lit("")) != "")
    )
    return out.withColumns(
        {
            "statement_amount_basis": F.coalesce(
                chosen, F.when(F.col("_status").isin(personal), F.lit("personal_share")).otherwise(F.lit("full_receipt"))
            ),
            "fx_rate": F.when(
                F.col("cad_amount_used").isNotNull() & (F.coalesce("fx_basis_amount", _zero(FX6)) != 0),
                (F.abs("cad_amount_used").try_cast(MONEY) / F.col("fx_basis_amount").try_cast(FX6)).try_cast(FX6),
            ),
            "statement_receipt_difference": F.when(
                shown, (F.abs("statement_purchase_amount") - expected).try_cast(MONEY)
            ),
            "fx_basis_status": F.when(
                F.col("cad_source") == "manual", F.concat(F.lit("manual_"), F.col("_status"))
            ).otherwise(F.col("_status")),
        }
    ).drop("_b", "_status")


def extraction_status(amount: Column, currency: Column, day: Column, vendor: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(amount.isNull() | blank(currency), F.lit("manual"))
        .when(day.isNull() | blank(vendor) | (vendor == "Unknown supplier"), F.lit("review"))
        .otherwise(F.lit("ok"))
    )


def review_status(reconciled: DataFrame, groups: DataFrame, allocations: DataFrame, scores: DataFrame) -> DataFrame:
    """CLM5: extraction status and confirmed / assumed_ok / review.

    scores: trip_id, source_file, group_id, score, similarity of the current matches.
    """
    direct = groups.filter(
        F.col("matched_file").isNotNull() & ~F.col("ignored") & (F.col("allocation_status") == "none")
    ).select("trip_id", F.col("matched_file").alias("source_file"), "group_id", "match_status")
    current = (
        direct.join(scores, ["trip_id", "source_file", "group_id"], "left")
        .groupBy(*RECEIPT)
        .agg(
            F.bool_or(F.col("match_status") == "manual").alias("_manual"),
            F.count("*").alias("_n"),
            F.min("score").alias("_score"),
            F.min("similarity").alias("_sim"),
        )
    )
    balanced = (
        allocations.filter("source_file is not null")
        .join(groups.filter("allocation_status = 'balanced'").select("trip_id", "group_id"), ["trip_id", "group_id"], "left_semi")
        .select(*RECEIPT)
        .distinct()
        .withColumn("_balanced", F.lit(True))
    )
    status = extraction_status(F.col("amount"), F.col("currency"), F.col("receipt_date"), F.col("vendor"))
    confirmed = F.coalesce("_manual", F.lit(False)) | F.coalesce("_balanced", F.lit(False))
    assumed = F.coalesce((F.col("_n") == 1) & (F.col("_score") >= 0.90) & (F.col("_sim") >= 0.35), F.lit(False))
    return (
        reconciled.join(current, RECEIPT, "left")
        .join(balanced, RECEIPT, "left")
        .withColumn("extraction_status", status)
        .withColumn(
            "review_status",
            F.when((F.col("extraction_status") != "ok") | (F.col("cad_source") == "unavailable"), F.lit("review"))
            .when(confirmed, F.lit("confirmed"))
            .when(assumed, F.lit("assumed_ok"))
            .otherwise(F.lit("review")),
        )
        .drop("_manual", "_n", "_score", "_sim", "_balanced")
    )


# ------------------------------------------------------------------ expense result


def _fraction(included: Column, excluded: Column, total: Column) -> tuple[Column, Column]:
    """(numerator, denominator) of a line ratio clipped to 0..1; 1/1 when nothing was excluded."""
    cut = (excluded > lit_dec("0.005")) & (F.coalesce(total, _zero()) != 0) & included.isNotNull()
    whole = F.abs(total)
    part = F.greatest(_zero(), F.least(whole, included * F.signum(total).cast("decimal(2,0)")))
    one = F.lit(1).try_cast(MONEY)
    return F.when(cut, part.try_cast(MONEY)).otherwise(one), F.when(cut, whole.try_cast(MONEY)).otherwise(one)


def expense_result(rows: DataFrame) -> DataFrame:
    """CLM6: claim amounts of each receipt.

    rows: receipt columns, LIN7 totals, CLM2-CLM4 columns and the trip's claim_program. Ratios
    stay as numerator and denominator, so a settlement is divided once and rounded once.
    """
    people = people_of().cast("decimal(6,0)")
    in_company = F.coalesce("in_company", F.lit(True))
    in_sponsor = F.coalesce("in_sponsor", F.lit(True)) & in_company
    total, comp, spon = F.col("line_total"), F.col("company_included_total"), F.col("sponsor_included_total")
    comp_out = (F.coalesce(total, _zero()) - F.coalesce(comp, _zero())).try_cast(MONEY)
    spon_out = (F.coalesce(comp, _zero()) - F.coalesce(spon, _zero())).try_cast(MONEY)
    sponsored = F.col("claim_program") == "sponsored"
    manual = F.col("manual_cad")
    cad = F.coalesce(
        manual, F.col("cad_amount_used"), F.when(F.upper("currency") == "CAD", F.col("amount"))
    )
    source = (
        F.when(manual.isNotNull(), F.lit("manual"))
        .when(F.col("cad_amount_used").isNull() & (F.upper("currency") == "CAD"), F.lit("invoice"))
        .otherwise(F.coalesce("cad_source", F.lit("unavailable")))
    )
    exact = source.isin(STATEMENT_SOURCES)
    personal = F.col("statement_amount_basis") == "personal_share"

    def program(included: Column, line_in: Column, line_out: Column) -> tuple[Column, Column, Column]:
        num, den = _fraction(line_in, line_out, total)
        cut = (line_out > lit_dec("0.005")) & (F.coalesce(total, _zero()) != 0) & line_in.isNotNull()
        original_basis = F.when(cut, line_in).otherwise(F.coalesce("amount", _zero())).try_cast(MONEY)
        original = F.when(included, (original_basis / people).try_cast(MONEY)).otherwise(_zero())
        full, share = part_of(cad, num, den, people), part_of(cad, num, den)
        value = (
            F.when(~included, _zero())
            .when(manual.isNotNull(), full)
            .when(cad.isNotNull() & exact, F.when(personal, share).otherwise(full))
            .otherwise(at_rate(original, F.col("fx_rate")))
        )
        ratio = F.when(included, (num / (den * people).cast("decimal(24,2)")).cast("decimal(10,8)")).otherwise(
            _zero("decimal(10,8)")
        )
        return value, original, ratio

    comp_cad, comp_original, comp_ratio = program(in_company, comp, comp_out)
    spon_cad, spon_original, spon_ratio = program(in_sponsor, spon, (comp_out + spon_out).try_cast(MONEY))
    own = F.coalesce("total_cad", _zero())
    claim = F.when(sponsored, F.least(own, F.coalesce("_spon_cad", _zero()))).otherwise(_zero())
    return (
        rows.withColumns(
            {
                "cad_amount_used": cad,
                "cad_source": source,
                "total_cad": comp_cad,
                "_spon_cad": spon_cad,
                "company_original": comp_original,
                "sponsor_original": spon_original,
                "company_ratio": comp_ratio,
                "sponsor_ratio": spon_ratio,
            }
        )
        .withColumn("in_company", in_company)
        .withColumn("in_sponsor", in_sponsor)
        .withColumns({"sponsor_claim_cad": claim.try_cast(MONEY)})
        .withColumns(
            {
                "sponsor_excluded_cad": F.when(sponsored, (own - F.col("sponsor_claim_cad")).try_cast(MONEY)).otherwise(_zero()),
                "reimbursable_cad": F.when(F.col("paid_by") == "traveller_personal", F.col("total_cad")).otherwise(_zero()),
                "corporate_paid_cad": F.when(F.col("paid_by") == "company_card", F.col("total_cad")).otherwise(_zero()),
                "company_excluded_cad": F.greatest(
                    _zero(), (F.coalesce("cad_amount_used", _zero()) - own).try_cast(MONEY)
                ),
                "claim_status": F.when(~F.col("in_company"), F.lit("excluded"))
                .when(F.col("cad_amount_used").isNotNull(), F.lit("ready"))
                .otherwise(F.lit("review")),
            }
        )
        .drop("_spon_cad")
    )


# ------------------------------------------------------------------ journal and controls

# Default profile
DEFAULT_ACCOUNTS = {
    "non_meal": "Travel – Non-meal",
    "meal_deductible": "Meals – Deductible (50%)",
    "meal_nondeductible": "Meals – Non-deductible (50%)",
    "gst_hst_receivable": "GST Receivable",
    "qst_receivable": "QST Receivable",
    "expenses_recoverable_from_clients": "Expenses Recoverable from Clients",
    "accounts_receivable": "Accounts Receivable",
    "bank_checking": "Bank – Checking",
}
DEFAULT_RATES = {
    "commercial_use_pct": "1",
    "normal_tax_recovery_pct": "1",
    "meal_tax_recovery_pct": "0.5",
    "normal_deduction_pct": "1",
    "meal_deduction_pct": "0.5",
}
PCT = "decimal(7,6)"
RESIDUAL_ORDER = ["meal_nondeductible", "non_meal", "meal_deductible"]


def default_mapping() -> Column:
    return F.create_map(*[F.lit(x) for pair in DEFAULT_ACCOUNTS.items() for x in pair])


def with_profile(rows: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Attach profile columns by trip; trips without one use the defaults."""
    if profiles is None:
        out = rows.withColumns({k: F.lit(v).cast(PCT) for k, v in DEFAULT_RATES.items()})
        return out.withColumns(
            {"gst_hst_registrant": F.lit(True), "qst_registrant": F.lit(True), "account_mapping": default_mapping()}
        )
    out = rows.join(profiles, "trip_id", "left")
    return out.withColumns(
        {
            **{k: F.coalesce(F.col(k), F.lit(v)).cast(PCT) for k, v in DEFAULT_RATES.items()},
            "gst_hst_registrant": F.coalesce("gst_hst_registrant", F.lit(True)),
            "qst_registrant": F.coalesce("qst_registrant", F.lit(True)),
            "account_mapping": F.coalesce("account_mapping", default_mapping()),
        }
    )


def tax_split(rows: DataFrame) -> DataFrame:
    """Recoverable tax, net and deductible parts per expense row (profile columns attached)."""
    meal = is_meal(F.col("expense_type"))
    claim = F.col("reimbursable_cad")
    fx = F.coalesce(
        F.nullif(F.col("fx_rate"), F.lit(0).cast(FX6)),
        F.when(F.col("currency") == "CAD", F.lit(1).try_cast(FX6)).otherwise(_zero(FX6)),
    )
    recovery = F.when(meal, F.col("meal_tax_recovery_pct")).otherwise(F.col("normal_tax_recovery_pct")) * F.col(
        "commercial_use_pct"
    )

    def tax(name: str, registered: str) -> Column:
        cad = at_rate(F.coalesce(F.col(name), _zero()), fx, F.col("company_ratio"))
        return F.when(F.col(registered), (cad * recovery).try_cast(POSTED)).otherwise(_zero(POSTED))

    out = rows.withColumn("_gst", tax("gst_hst", "gst_hst_registrant")).withColumn("_qst", tax("qst", "qst_registrant"))
    net = (claim - F.col("_gst") - F.col("_qst")).try_cast(POSTED)
    return out.withColumn("recoverable_gst", F.col("_gst")).withColumn("recoverable_qst", F.col("_qst")).withColumn(
        "net_cad", net
    ).drop("_gst", "_qst")


def posting_lines(expenses: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(trip, account key, account, amount) before rounding, one row per non-zero component."""
    rows = with_profile(expenses, profiles).filter(F.col("reimbursable_cad").isNotNull() & F.col("in_company"))
    split = tax_split(rows)
    meal = is_meal(F.col("expense_type"))
    sponsored = F.col("claim_program") == "sponsored"
    claim = F.col("reimbursable_cad").try_cast(POSTED)
    passed = F.least(claim, F.coalesce("sponsor_claim_cad", _zero()).try_cast(POSTED))
    borne = (claim - passed).try_cast(POSTED)
    base = F.when(sponsored, borne).otherwise(F.col("net_cad"))
    deductible = (base * F.col("meal_deduction_pct") * F.col("commercial_use_pct")).try_cast(POSTED)
    nothing = _zero(POSTED)
    parts = {
        "expenses_recoverable_from_clients": F.when(sponsored, passed).otherwise(nothing),
        "meal_deductible": F.when(meal, deductible).otherwise(nothing),
        "meal_nondeductible": F.when(meal, (base - deductible).try_cast(POSTED)).otherwise(nothing),
        "non_meal": F.when(meal, nothing).otherwise(base),
        "gst_hst_receivable": F.when(sponsored, nothing).otherwise(F.col("recoverable_gst")),
        "qst_receivable": F.when(sponsored, nothing).otherwise(F.col("recoverable_qst")),
    }
    items = F.array(
        *[F.struct(F.lit(k).alias("account_key"), v.try_cast(POSTED).alias("part")) for k, v in parts.items()]
    )
    return (
        split.select("trip_id", "account_mapping", F.explode(items).alias("p"))
        .filter(F.col("p.part") != 0)
        .select(
            "trip_id",
            F.col("p.account_key").alias("account_key"),
            F.col("account_mapping")[F.col("p.account_key")].alias("account"),
            F.col("p.part").alias("part"),
        )
    )


def journal(expenses: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """CLM7: rounded account rows per trip with the rounding residual on the preferred account.

    After the aggregate a trip has at most eight rows, so the window over a trip is small.
    """
    summed = (
        posting_lines(expenses, profiles)
        .groupBy("trip_id", "account")
        .agg(F.min("account_key").alias("account_key"), F.sum("part").alias("_sum"))
        .withColumn("amount_cad", F.col("_sum").try_cast(MONEY))
        .filter(F.abs("_sum") >= lit_dec("0.005"))
    )
    claim = expenses.groupBy("trip_id").agg(
        F.coalesce(F.sum("reimbursable_cad"), _zero()).try_cast(MONEY).alias("claim_total")
    )
    trip = Window.partitionBy("trip_id")
    rank = F.coalesce(
        *[F.when(F.col("account_key") == k, F.lit(i)) for i, k in enumerate(RESIDUAL_ORDER)], F.lit(99)
    )
    j = summed.join(claim, "trip_id").withColumn("_journal", F.sum("amount_cad").over(trip).try_cast(MONEY))
    residual = (F.col("claim_total") - F.col("_journal")).try_cast(MONEY)
    target = F.row_number().over(trip.orderBy(rank, "account")) == 1
    adjust = F.when(
        target & (F.abs(residual) >= lit_dec("0.005")) & (F.abs(residual) <= lit_dec("0.05")), residual
    ).otherwise(_zero())
    return j.withColumn("rounding_adjustment_cad", adjust.try_cast(MONEY)).select(
        "trip_id",
        "account_key",
        "account",
        (F.col("amount_cad") + F.col("rounding_adjustment_cad")).try_cast(MONEY).alias("amount_cad"),
        "rounding_adjustment_cad",
    )


def claim_summary(expenses: DataFrame) -> DataFrame:
    """CLM10: trip totals and counters."""

    def total(name: str, alias: str) -> Column:
        return F.coalesce(F.sum(name), _zero()).try_cast(MONEY).alias(alias)

    return expenses.groupBy("trip_id").agg(
        F.count("*").alias("expense_count"),
        F.count_if(F.col("in_company")).alias("included_count"),
        F.count_if(~F.col("in_company")).alias("excluded_count"),
        F.count_if(F.col("cad_source").isin(STATEMENT_SOURCES)).alias("matched_count"),
        total("total_cad", "reviewed_total_cad"),
        total("reimbursable_cad", "reimbursement_total_cad"),
        total("corporate_paid_cad", "corporate_paid_total_cad"),
        total("sponsor_claim_cad", "sponsor_claim_total_cad"),
        total("sponsor_excluded_cad", "sponsor_excluded_total_cad"),
        total("company_excluded_cad", "excluded_or_personal_cad"),
    )


def controls(expenses: DataFrame, journal_rows: DataFrame, trips: DataFrame) -> DataFrame:
    """CLM8: payer, sponsor and accounting differences per trip."""
    s = claim_summary(expenses)
    jt = journal_rows.groupBy("trip_id").agg(F.sum("amount_cad").try_cast(MONEY).alias("journal_total"))
    j = s.join(jt, "trip_id", "left").join(trips.select("trip_id", "claim_program"), "trip_id")
    payer = (F.col("reviewed_total_cad") - F.col("reimbursement_total_cad") - F.col("corporate_paid_total_cad")).try_cast(MONEY)
    sponsor = F.when(
        F.col("claim_program") == "sponsored",
        (F.col("reviewed_total_cad") - F.col("sponsor_claim_total_cad") - F.col("sponsor_excluded_total_cad")).try_cast(MONEY),
    ).otherwise(_zero())
    accounting = (F.coalesce("journal_total", _zero()) - F.col("reimbursement_total_cad")).try_cast(MONEY)
    ok = lambda c: F.coalesce(F.abs(c) <= lit_dec(CONTROL_TOLERANCE), F.lit(False))
    return j.select(
        "trip_id",
        payer.alias("payer_difference_cad"),
        sponsor.alias("sponsor_difference_cad"),
        accounting.alias("accounting_difference_cad"),
        (ok(payer) & ok(sponsor) & ok(accounting)).alias("valid"),
    )


def group_needs_review(groups: DataFrame, cad_sources: DataFrame) -> DataFrame:
    """Groups in use that still need a mapping or CAD review.

    cad_sources: trip_id, source_file, cad_source of receipts (a manual CAD amount settles a group).
    """
    src = cad_sources.select("trip_id", F.col("source_file").alias("matched_file"), F.col("cad_source").alias("_src"))
    j = groups.join(src, ["trip_id", "matched_file"], "left")
    split = F.col("allocation_status") != "none"
    used = F.col("matched_file").isNotNull() & (
        F.col("normalization_status").isin("review", "possible_duplicate")
        | ((F.col("cad_completeness") != "complete") & (F.coalesce("_src", F.lit("")) != "manual"))
    )
    return j.withColumn(
        "needs_review",
        F.col("match_eligible")
        & ~F.col("ignored")
        & F.when(split, F.col("allocation_status") != "balanced").otherwise(used),
    ).drop("_src")


def reconciliation_summary(reconciled: DataFrame, groups: DataFrame) -> DataFrame:
    """CLM11: counters per trip; both sides are aggregated before they meet."""
    r = reconciled.groupBy("trip_id").agg(
        F.count("*").alias("receipt_count"),
        F.count_if(F.col("group_count") > 0).alias("matched_receipt_count"),
    )
    live = F.col("match_eligible") & ~F.col("ignored")
    flagged = group_needs_review(groups, reconciled)
    g = flagged.groupBy("trip_id").agg(
        F.count_if(live).alias("group_count"),
        F.count_if(
            live & (F.col("matched_file").isNotNull() | (F.col("allocation_status") == "balanced"))
        ).alias("matched_group_count"),
        F.count_if(~live).alias("audit_group_count"),
        F.count_if(~F.col("allocation_status").isin("none", "balanced")).alias("incomplete_allocation_count"),
        F.count_if("needs_review").alias("needs_review_count"),
    )
    return r.join(g, "trip_id", "full").na.fill(0)


def unmatched_receipts(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter("group_count = 0")


def unmatched_groups(groups: DataFrame) -> DataFrame:
    return groups.filter(
        "match_eligible and not ignored and matched_file is null and allocation_status = 'none'"
    )


def policy_warnings(reconciled: DataFrame, groups: DataFrame, allocations: DataFrame, trips: DataFrame) -> DataFrame:
    """CLM12. trips: trip_id, allowed_categories array, meal_limit, personal_treatment, policy_exceptions map."""
    j = reconciled.join(
        trips.select("trip_id", "allowed_categories", "meal_limit", "policy_exceptions"), "trip_id"
    )
    kind = F.coalesce("expense_type", F.lit("other"))
    bad = ~F.array_contains("allowed_categories", kind)
    over = (kind == "meal") & F.col("meal_limit").isNotNull() & (F.abs("cad_amount_used") > F.col("meal_limit"))

    def warn(when: Column, warning_id: Column, message: Column) -> Column:
        return F.when(
            F.coalesce(when, F.lit(False)), F.struct(warning_id.alias("warning_id"), message.alias("message"))
        )

    file = F.col("source_file")
    rules = F.array_compact(
        F.array(
            warn(
                bad,
                F.concat(F.lit("category:"), file),
                F.concat(file, F.lit(": category "), kind, F.lit(" is not allowed by the selected policy.")),
            ),
            warn(
                over,
                F.concat(F.lit("meal_limit:"), file),
                F.concat(
                    file, F.lit(": meal CAD "), F.col("cad_amount_used").cast("string"), F.lit(" exceeds the "),
                    F.col("meal_limit").cast("string"), F.lit(" policy limit."),
                ),
            ),
        )
    )
    receipt_level = j.select("trip_id", "policy_exceptions", F.explode(rules).alias("w"))
    personal = (
        allocations.filter("type = 'personal'")
        .join(groups.select("trip_id", "group_id", "description"), ["trip_id", "group_id"])
        .join(
            trips.filter(F.col("personal_treatment").isin("review", "prohibit")).select("trip_id", "policy_exceptions"),
            "trip_id",
        )
        .select(
            "trip_id",
            "policy_exceptions",
            F.struct(
                F.concat_ws(":", F.lit("personal"), "group_id", "allocation_id").alias("warning_id"),
                F.concat(
                    F.coalesce(F.nullif("description", F.lit("")), F.col("group_id")), F.lit(": personal allocation of "),
                    F.col("cad_amount").cast("string"), F.lit(" CAD requires review."),
                ).alias("message"),
            ).alias("w"),
        )
    )
    note = F.trim(F.coalesce(F.col("policy_exceptions")[F.col("w.warning_id")], F.lit("")))
    return receipt_level.unionByName(personal).select(
        "trip_id", "w.warning_id", "w.message", note.alias("exception_note"), (note != "").alias("resolved")
    )


def issues(
    expenses: DataFrame,
    lines: DataFrame,
    exceptions: DataFrame,
    groups: DataFrame,
    warnings: DataFrame,
    control_rows: DataFrame,
    trips: DataFrame,
) -> DataFrame:
    """CLM9: blocking and warning queue; every rule is one narrow DataFrame, united at the end."""

    def issue(df: DataFrame, kind: str, severity: str, reference: Column, message: Column, target: str) -> DataFrame:
        return df.select(
            "trip_id",
            F.lit(kind).alias("kind"),
            F.lit(severity).alias("severity"),
            reference.cast("string").alias("reference"),
            message.alias("message"),
            F.lit(target).alias("target"),
        )

    file = F.col("source_file")
    out_line = F.col("in_company") & ~F.col("in_sponsor") & (F.coalesce("exclusion_reason", F.lit("")) == "")
    sponsored = trips.filter("claim_program = 'sponsored'").select("trip_id")
    parts = [
        issue(
            exceptions.filter("severity = 'blocking'"), "extraction", "blocking", F.col("exception_id"),
            F.concat(file, F.lit(": "), F.col("message")), "receipt-review",
        ),
        issue(
            group_needs_review(groups, expenses).filter("needs_review"), "statement_mapping", "blocking", F.col("group_id"),
            F.concat(F.coalesce(F.nullif("description", F.lit("")), F.lit("Statement transaction")), F.lit(" needs a mapping or CAD review.")),
            "unmatched-statements",
        ),
        issue(warnings.filter("not resolved"), "policy", "blocking", F.col("warning_id"), F.col("message"), "policy-review"),
        issue(
            expenses.filter("in_company and cad_amount_used is null"), "cad_amount", "blocking", file,
            F.concat(file, F.lit(": no exact CAD amount is available.")), "receipt",
        ),
        issue(
            expenses.filter("in_company and cad_amount_used is not null and fx_basis_status = 'receipt_fallback_mismatch'"),
            "fx_basis", "warning", file,
            F.concat(file, F.lit(": the statement amount does not align with the receipt total or traveller share.")), "receipt",
        ),
        issue(
            lines.filter(out_line).join(sponsored, "trip_id", "left_semi"), "sponsor_exclusion", "blocking", F.col("line_id"),
            F.concat(file, F.lit(": choose a reason for each sponsor-excluded line.")), "receipt",
        ),
        *[
            issue(
                control_rows.filter(F.abs(c) > lit_dec(CONTROL_TOLERANCE)), kind, "blocking", F.lit(None),
                F.concat(F.lit(text + "; difference "), F.col(c).cast("string"), F.lit(" CAD.")), "contract-controls",
            )
            for kind, c, text in (
                ("payer_control", "payer_difference_cad", "Reviewed total does not equal traveller reimbursement and company-paid amounts"),
                ("sponsor_control", "sponsor_difference_cad", "Sponsor claim plus exclusions does not equal the reviewed total"),
                ("accounting_control", "accounting_difference_cad", "Accounting components do not equal traveller reimbursement"),
            )
        ],
        issue(
            trips.filter("coalesce(claim_program, '') = ''"), "trip_details", "blocking", F.lit("reimbursement program"),
            F.lit("Complete trip detail: reimbursement program."), "trip-record",
        ),
        issue(
            trips.filter("coalesce(traveller, '') = ''"), "trip_details", "blocking", F.lit("traveller"),
            F.lit("Complete trip detail: traveller."), "trip-record",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
