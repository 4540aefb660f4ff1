"""Queries of receipt lines, CAD basis, claims, journal and controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripledger.operators import claims, decisions, lines
from tripledger.plans import tables
from tripledger.plans.bindings import oracle, view
from tripledger.plans.oracle_parts import CAD, CLAIM, LINES, cents, half_up, money
from tripledger.plans.q_decisions import DEC2, DEC4
from tripledger.plans.registry import query

LINE_IN = "receipts receipt_lines trips"
CLAIM_IN = "receipts receipt_lines trips matched_groups dispositions allocations basis"
DECIDED = DEC2.format(base="matched_groups") + "," + DEC4.format(base="dec2")
CAD_PARTS = DECIDED + "," + LINES + "," + CAD
ALL_PARTS = CAD_PARTS + "," + CLAIM
LINE_COLS = ["trip_id", "source_file", "pos", "description", "amount", "line_type"]


def claim_oracle(body: str, more: str = "", views: str = "") -> str:
    return oracle(f"{CLAIM_IN} {views}", body, ALL_PARTS + more)


@query(
    "txt18_tax_line_type",
    oracle(
        "receipt_lines",
        "SELECT description, count(*) AS n, CASE WHEN description = 'GST' THEN 'gst_hst' END AS kind FROM receipt_lines GROUP BY 1",
    ),
)
def _(spark, d):
    counted = view(spark, d, "receipt_lines").groupBy("description").agg(F.count("*").alias("n"))
    return counted.withColumn("kind", lines.tax_line_type(F.col("description")))


@query(
    "lin1_canonical_tax_lines",
    oracle(
        LINE_IN,
        """SELECT trip_id, source_file, pos, description, amount, 'item' AS line_type FROM receipt_lines WHERE description <> 'GST'
UNION ALL
SELECT r.trip_id, r.source_file, CAST(9000000000000000000 AS BIGINT), 'GST/HST', CAST(coalesce(gst_hst, (SELECT arg_min(amount, pos) FROM receipt_lines l
   WHERE l.trip_id = r.trip_id AND l.source_file = r.source_file AND l.description = 'GST'), 0) AS DECIMAL(18,2)), 'gst_hst' FROM receipts r
UNION ALL SELECT trip_id, source_file, CAST(9000000000000000001 AS BIGINT), 'QST', CAST(coalesce(qst, 0) AS DECIMAL(18,2)), 'qst' FROM receipts""",
    ),
)
def _(spark, d):
    _, out = lines.canonical_tax_lines(view(spark, d, "receipt_lines"), view(spark, d, "receipts"))
    return out.select(*LINE_COLS)


@query(
    "lin2_gap_line",
    oracle(
        LINE_IN,
        """, j AS (SELECT r.*, coalesce(s.line_total, 0) AS lt, CAST(r.amount - coalesce(s.line_total, 0) AS DECIMAL(18,2)) AS gap, coalesce(s.n, 0) AS n
  FROM receipts r LEFT JOIN (SELECT trip_id, source_file, sum(amount) AS line_total, count_if(line_type = 'item') AS n
       FROM (SELECT trip_id, source_file, amount, 'item' AS line_type FROM receipt_lines) GROUP BY 1, 2) s
    ON s.trip_id = r.trip_id AND s.source_file = r.source_file WHERE r.amount IS NOT NULL)
SELECT trip_id, source_file, CASE WHEN expense_type = 'meal' THEN 'Tip' WHEN abs(subtotal - gap) <= 0.05 OR n = 0 THEN 'Receipt subtotal' ELSE 'Unreconciled receipt item - review' END AS description,
       gap AS amount FROM j WHERE CASE WHEN expense_type = 'meal' THEN gap > 0.05 ELSE gap > greatest(0.05, amount * 0.03) END""",
    ).replace("\n, j AS", ", j AS"),
)
def _(spark, d):
    return lines.gap_line(
        view(spark, d, "receipt_lines").withColumn("line_type", F.lit("item")), view(spark, d, "receipts")
    ).select("trip_id", "source_file", "description", "amount")


@query(
    "lin3_minimum_lines",
    oracle(
        LINE_IN,
        """SELECT trip_id, source_file, CASE WHEN amount IS NULL THEN 'Receipt total missing - review' WHEN expense_type = 'meal' THEN 'Receipt total - review meal line items' ELSE 'Receipt total' END AS description, amount
FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM receipt_lines l WHERE l.trip_id = r.trip_id AND l.source_file = r.source_file)
UNION ALL SELECT trip_id, source_file, 'Alcohol adjustment - manual', CAST(0 AS DECIMAL(18,2)) FROM receipts""",
    ),
)
def _(spark, d):
    rows, receipts = view(spark, d, "receipt_lines"), view(spark, d, "receipts")
    out = lines.minimum_lines(rows, receipts).unionByName(lines.alcohol_placeholder(rows, receipts))
    return out.select("trip_id", "source_file", "description", "amount")


@query(
    "lin4_reconcile_note",
    oracle(
        LINE_IN,
        """SELECT r.trip_id, r.source_file, CASE WHEN expense_type <> 'meal' THEN '' WHEN amount IS NULL THEN 'Missing receipt total; review manually.'
       WHEN t IS NULL THEN 'No reliable meal line items extracted; review alcohol manually.'
       WHEN abs(t - amount) > greatest(0.05, amount * 0.03) THEN concat('Line items total ', CAST(t AS VARCHAR), ' differs from receipt total ', CAST(amount AS VARCHAR), '; review line items/alcohol.')
       ELSE '' END AS note
FROM receipts r LEFT JOIN (SELECT trip_id, source_file, CAST(sum(amount) AS DECIMAL(18,2)) AS t FROM receipt_lines GROUP BY 1, 2) s ON s.trip_id = r.trip_id AND s.source_file = r.source_file""",
    ),
)
def _(spark, d):
    return lines.reconcile_note(view(spark, d, "receipt_lines"), view(spark, d, "receipts"))


@query(
    "lin5_stable_ids",
    oracle(
        LINE_IN,
        """SELECT trip_id, source_file, pos, concat('LI-', left(sha256(concat(source_file, '|', sig, '|', CAST(rn AS VARCHAR))), 16)) AS line_id,
       concat('RCPT-', left(sha256(concat(trip_id, chr(0), source_file)), 20)) AS receipt_id
FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, source_file, sig ORDER BY pos) AS rn
      FROM (SELECT *, concat(lower(trim(description)), '|', CAST(amount AS VARCHAR)) AS sig FROM receipt_lines))""",
    ),
)
def _(spark, d):
    return lines.line_ids(view(spark, d, "receipt_lines")).select(
        "trip_id", "source_file", "pos", "line_id", lines.receipt_id().alias("receipt_id")
    )


@query(
    "lin6_program_inclusion",
    oracle(LINE_IN, "SELECT trip_id, source_file, pos, in_company, in_sponsor, exclusion_reason FROM lines_prog", LINES),
)
def _(spark, d):
    return tables.program_lines(spark, d).select(
        "trip_id", "source_file", "pos", "in_company", "in_sponsor", "exclusion_reason"
    )


def _share(expr: str) -> str:
    return money(half_up(cents(expr), "number_of_people"))


@query(
    "lin7_receipt_totals",
    oracle(
        LINE_IN,
        f"""SELECT trip_id, source_file, line_total, company_included_total, sponsor_included_total,
       CAST(company_included_total - sponsor_included_total AS DECIMAL(18,2)) AS sponsor_excluded_total, CAST(line_total - amount AS DECIMAL(18,2)) AS difference,
       coalesce(line_total = amount, false) AS reconciled,
       CASE WHEN NOT coalesce(line_total = amount, false) THEN 'review' WHEN expense_type <> 'meal' THEN 'not_applicable' ELSE 'ok' END AS automatic_status,
       expense_type = 'meal' AND (line_total - CASE WHEN claim_program = 'sponsored' THEN sponsor_included_total ELSE company_included_total END) > 0.005 AND NOT coalesce(line_total = amount, false) AS blocking,
       CASE WHEN amount IS NULL THEN NULL ELSE {_share("amount")} END AS per_person_total, {_share("sponsor_included_total")} AS per_person_sponsor_total
FROM totals""",
        LINES,
    ),
)
def _(spark, d):
    receipts = view(spark, d, "receipts").join(view(spark, d, "trips").select("trip_id", "claim_program"), "trip_id")
    return lines.receipt_totals(tables.program_lines(spark, d), receipts).select(
        "trip_id", "source_file", "line_total", "company_included_total", "sponsor_included_total", "sponsor_excluded_total",
        "difference", "reconciled", "automatic_status", "blocking", "per_person_total", "per_person_sponsor_total",
    )


@query(
    "lin8_sponsor_amounts",
    oracle(
        LINE_IN,
        f"""SELECT r.trip_id, r.source_file,
       CASE WHEN anyout AND kept > 0 THEN {_share("kept")} ELSE {_share("coalesce(r.amount, 0)")} END AS original_claim,
       CASE WHEN in_company AND NOT in_sponsor THEN CAST(0 AS DECIMAL(18,2)) ELSE {_share("coalesce(alc, 0)")} END AS removed_alcohol,
       CASE WHEN in_company AND NOT in_sponsor THEN {_share("coalesce(r.amount, 0)")} ELSE {_share("coalesce(oth, 0)")} END AS removed_other
FROM receipts r LEFT JOIN (SELECT trip_id, source_file, bool_or(NOT in_sponsor) AS anyout, sum(amount) FILTER (in_sponsor) AS kept,
    sum(amount) FILTER (NOT in_sponsor AND is_alcohol) AS alc, sum(amount) FILTER (NOT in_sponsor AND NOT is_alcohol) AS oth FROM lines_prog GROUP BY 1, 2) s
  ON s.trip_id = r.trip_id AND s.source_file = r.source_file""",
        LINES,
    ),
)
def _(spark, d):
    return lines.sponsor_amounts(tables.program_lines(spark, d), view(spark, d, "receipts"))


@query(
    "lin9_tax_documentation",
    oracle(
        "receipts",
        """, w AS (SELECT *, concat_ws('; ', CASE WHEN amount >= 100 AND gst_hst > 0 AND gst_hst_number = '' THEN 'GST/HST number missing' END,
     CASE WHEN amount >= 100 AND qst > 0 AND qst_number = '' THEN 'QST number missing' END,
     CASE WHEN currency = 'CAD' AND amount >= 500 AND purchaser_name = '' THEN 'purchaser name missing' END,
     CASE WHEN currency = 'CAD' AND amount >= 500 AND payment_terms = '' THEN 'payment terms missing' END,
     CASE WHEN currency = 'CAD' AND amount >= 500 AND description = '' THEN 'expense description missing' END) AS msg FROM receipts)
SELECT trip_id, source_file, CASE WHEN country NOT IN ('', 'Canada') THEN 'not_applicable' WHEN msg <> '' THEN 'review' WHEN country = 'Canada' OR currency = 'CAD' THEN 'ok' ELSE 'not_applicable' END AS tax_documentation_status,
       CASE WHEN country IN ('', 'Canada') AND msg <> '' THEN concat('Tax documentation: ', msg, '.') ELSE '' END AS tax_documentation_note FROM w""",
    ).replace("\n, w AS", ", w AS"),
)
def _(spark, d):
    return lines.tax_documentation(view(spark, d, "receipts")).select(
        "trip_id", "source_file", "tax_documentation_status", "tax_documentation_note"
    )


@query(
    "alc1_prorate_money",
    oracle(
        LINE_IN,
        f"""SELECT trip_id, source_file, pos, CAST(sh + CASE WHEN rn_last = 1 THEN amount_r - sum(sh) OVER (PARTITION BY trip_id, source_file) ELSE 0 END AS DECIMAL(18,2)) AS prorated
FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, source_file ORDER BY pos DESC) AS rn_last,
        {money(half_up(f"({cents('amount_r')} * {cents('amount')})", cents("w")))} AS sh
      FROM (SELECT l.*, r.amount AS amount_r, sum(l.amount) OVER (PARTITION BY l.trip_id, l.source_file) AS w FROM receipt_lines l JOIN receipts r ON r.trip_id = l.trip_id AND r.source_file = l.source_file WHERE r.amount IS NOT NULL))""",
    ),
)
def _(spark, d):
    totals = view(spark, d, "receipts").filter("amount is not null").select(
        "trip_id", "source_file", F.col("amount").alias("total")
    )
    rows = view(spark, d, "receipt_lines").join(totals, ["trip_id", "source_file"])
    out = lines.prorate_money(rows, ["trip_id", "source_file"], "total", "amount", ["pos"], "prorated")
    return out.select("trip_id", "source_file", "pos", "prorated")


CLM1_COLS = "trip_id, source_file, cad_total, statement_purchase_amount, statement_purchase_currency, incomplete, allocated, group_count"


@query("clm1_receipt_cad_totals", claim_oracle(f"SELECT {CLM1_COLS} FROM cad_totals"))
def _(spark, d):
    return claims.receipt_cad_totals(
        tables.decided_groups(spark, d), view(spark, d, "allocations"), view(spark, d, "receipts")
    ).select(*CLM1_COLS.split(", "))


@query("clm2_cad_source", claim_oracle("SELECT trip_id, source_file, cad_amount_used, cad_source FROM sourced"))
def _(spark, d):
    receipts = view(spark, d, "receipts")
    totals = claims.receipt_cad_totals(tables.decided_groups(spark, d), view(spark, d, "allocations"), receipts)
    return claims.cad_source(receipts, totals).select("trip_id", "source_file", "cad_amount_used", "cad_source")


@query(
    "clm3_accounting_basis",
    claim_oracle(
        "SELECT trip_id, source_file, CAST(fx_basis_amount AS DECIMAL(18,6)) AS fx_basis_amount, fx_basis_status, statement_amount_basis FROM reconciled"
    ),
)
def _(spark, d):
    return tables.reconciled(spark, d).select(
        "trip_id", "source_file", "fx_basis_amount", "fx_basis_status", "statement_amount_basis"
    )


@query(
    "clm4_fx_rate_used",
    claim_oracle("SELECT trip_id, source_file, fx_rate, statement_receipt_difference FROM reconciled"),
)
def _(spark, d):
    return tables.reconciled(spark, d).select("trip_id", "source_file", "fx_rate", "statement_receipt_difference")


@query(
    "clm5_review_status",
    claim_oracle(
        """SELECT r.trip_id, r.source_file, CASE WHEN amount IS NULL OR currency = '' THEN 'manual' WHEN receipt_date IS NULL OR vendor = '' THEN 'review' ELSE 'ok' END AS extraction_status,
       CASE WHEN amount IS NULL OR receipt_date IS NULL OR cad_source = 'unavailable' THEN 'review' WHEN bal THEN 'confirmed' WHEN n = 1 THEN 'assumed_ok' ELSE 'review' END AS review_status
FROM reconciled r
LEFT JOIN (SELECT trip_id, matched_file, count(*) AS n FROM dec4 WHERE allocation_status = 'none' AND NOT ignored AND matched_file IS NOT NULL GROUP BY 1, 2) m
  ON m.trip_id = r.trip_id AND m.matched_file = r.source_file
LEFT JOIN (SELECT DISTINCT a.trip_id, a.source_file, true AS bal FROM allocations a JOIN dec4 g ON g.trip_id = a.trip_id AND g.group_id = a.group_id AND g.allocation_status = 'balanced' WHERE a.source_file IS NOT NULL) b
  ON b.trip_id = r.trip_id AND b.source_file = r.source_file"""
    ),
)
def _(spark, d):
    groups = tables.decided_groups(spark, d)
    scores = groups.filter("matched_file is not null").select(
        "trip_id",
        F.col("matched_file").alias("source_file"),
        "group_id",
        F.lit(0.95).alias("score"),
        F.lit(1.0).alias("similarity"),
    )
    return claims.review_status(tables.reconciled(spark, d), groups, view(spark, d, "allocations"), scores).select(
        "trip_id", "source_file", "extraction_status", "review_status"
    )


CLM6_COLS = (
    "trip_id, source_file, cad_amount_used, cad_source, total_cad, reimbursable_cad, corporate_paid_cad, "
    "sponsor_claim_cad, sponsor_excluded_cad, claim_status"
)


@query("clm6_expense_result", claim_oracle(f"SELECT {CLM6_COLS} FROM expenses"))
def _(spark, d):
    return tables.expenses(spark, d).select(*CLM6_COLS.split(", "))


@query("clm7_journal", claim_oracle("SELECT trip_id, account_key, amount_cad, rounding_adjustment_cad FROM journal"))
def _(spark, d):
    return claims.journal(tables.expenses(spark, d)).select(
        "trip_id", "account_key", "amount_cad", "rounding_adjustment_cad"
    )


@query(
    "clm8_controls",
    claim_oracle(
        """SELECT *, abs(payer_difference_cad) <= 0.02 AND abs(sponsor_difference_cad) <= 0.02 AND abs(accounting_difference_cad) <= 0.02 AS valid FROM control"""
    ),
)
def _(spark, d):
    e = tables.materialize(tables.expenses(spark, d))
    return claims.controls(e, claims.journal(e), view(spark, d, "trips"))


EXCEPTION_SQL = """, exceptions AS (
  SELECT trip_id, source_file, concat(source_file, ':', f, ':missing') AS exception_id, 'blocking' AS severity, concat(f, ' is required.') AS message
  FROM (SELECT trip_id, source_file, 'date' AS f FROM receipts WHERE receipt_date IS NULL UNION ALL SELECT trip_id, source_file, 'amount' FROM receipts WHERE amount IS NULL))"""
POLICY_SQL = """, policy AS (
  SELECT r.trip_id, concat('category:', source_file) AS warning_id FROM reconciled r WHERE expense_type NOT IN ('flight', 'hotel', 'meal', 'transport')
  UNION ALL SELECT r.trip_id, concat('meal_limit:', source_file) FROM reconciled r JOIN trips t ON t.trip_id = r.trip_id WHERE expense_type = 'meal' AND abs(cad_amount_used) > meal_limit
  UNION ALL SELECT a.trip_id, concat('personal:', a.group_id, ':', allocation_id) FROM allocations a JOIN matched_groups g ON g.trip_id = a.trip_id AND g.group_id = a.group_id WHERE type = 'personal'),
needs AS (
  SELECT g.*, match_eligible AND NOT ignored AND CASE WHEN allocation_status <> 'none' THEN allocation_status <> 'balanced'
        ELSE matched_file IS NOT NULL AND (normalization_status IN ('review', 'possible_duplicate') OR (cad_completeness <> 'complete' AND coalesce(src, '') <> 'manual')) END AS needs_review
  FROM (SELECT d.*, r.cad_source AS src FROM dec4 d LEFT JOIN reconciled r ON r.trip_id = d.trip_id AND r.source_file = d.matched_file) g)"""


def _policy_trips(spark, d):
    return view(spark, d, "trips").withColumns(
        {
            "allowed_categories": F.array(*[F.lit(c) for c in ("flight", "hotel", "meal", "transport")]),
            "personal_treatment": F.lit("review"),
            "policy_exceptions": F.create_map(F.lit("none"), F.lit("")),
        }
    )


def _exceptions(spark, d):
    r = view(spark, d, "receipts")
    parts = [
        r.filter(F.col(c).isNull()).select(
            "trip_id",
            "source_file",
            F.concat("source_file", F.lit(f":{label}:missing")).alias("exception_id"),
            F.lit("blocking").alias("severity"),
            F.lit(f"{label} is required.").alias("message"),
        )
        for c, label in (("receipt_date", "date"), ("amount", "amount"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "clm9_issues",
    claim_oracle(
        """SELECT trip_id, kind, severity, count(*) AS n FROM (
  SELECT trip_id, 'extraction' AS kind, 'blocking' AS severity FROM exceptions
  UNION ALL SELECT trip_id, 'statement_mapping', 'blocking' FROM needs WHERE needs_review
  UNION ALL SELECT trip_id, 'policy', 'blocking' FROM policy
  UNION ALL SELECT trip_id, 'cad_amount', 'blocking' FROM expenses WHERE in_company AND cad_amount_used IS NULL
  UNION ALL SELECT trip_id, 'fx_basis', 'warning' FROM expenses WHERE in_company AND cad_amount_used IS NOT NULL AND fx_basis_status = 'receipt_fallback_mismatch'
  UNION ALL SELECT trip_id, 'payer_control', 'blocking' FROM control WHERE abs(payer_difference_cad) > 0.02
  UNION ALL SELECT trip_id, 'sponsor_control', 'blocking' FROM control WHERE abs(sponsor_difference_cad) > 0.02
  UNION ALL SELECT trip_id, 'accounting_control', 'blocking' FROM control WHERE abs(accounting_difference_cad) > 0.02)
GROUP BY 1, 2, 3""",
        EXCEPTION_SQL + POLICY_SQL,
    ),
)
def _(spark, d):
    groups = tables.materialize(tables.decided_groups(spark, d))
    settled = tables.materialize(tables.reconciled(spark, d, groups))
    program = tables.materialize(tables.program_lines(spark, d))
    e = tables.materialize(tables.expenses(spark, d, program, settled))
    trips = _policy_trips(spark, d)
    ctl = claims.controls(e, claims.journal(e), trips)
    warnings = claims.policy_warnings(settled, groups, view(spark, d, "allocations"), trips)
    rows = lines.line_ids(program, written=True)
    out = claims.issues(e, rows, _exceptions(spark, d), groups, warnings, ctl, trips)
    return out.groupBy("trip_id", "kind", "severity").agg(F.count("*").alias("n"))


@query("clm10_claim_summary", claim_oracle("SELECT * FROM summary"))
def _(spark, d):
    return claims.claim_summary(tables.expenses(spark, d))


@query(
    "clm11_reconciliation_summary",
    claim_oracle(
        """SELECT coalesce(r.trip_id, g.trip_id) AS trip_id, coalesce(rc, 0) AS receipt_count, coalesce(mrc, 0) AS matched_receipt_count, coalesce(gc, 0) AS group_count, coalesce(mgc, 0) AS matched_group_count,
       coalesce(ac, 0) AS audit_group_count, coalesce(ic, 0) AS incomplete_allocation_count, coalesce(nr, 0) AS needs_review_count
FROM (SELECT trip_id, count(*) AS rc, count_if(group_count > 0) AS mrc FROM reconciled GROUP BY 1) r
FULL JOIN (SELECT trip_id, count_if(match_eligible AND NOT ignored) AS gc, count_if(match_eligible AND NOT ignored AND (matched_file IS NOT NULL OR allocation_status = 'balanced')) AS mgc,
   count_if(NOT match_eligible OR ignored) AS ac, count_if(allocation_status NOT IN ('none', 'balanced')) AS ic, count_if(needs_review) AS nr FROM needs GROUP BY 1) g ON g.trip_id = r.trip_id""",
        POLICY_SQL,
    ),
)
def _(spark, d):
    return claims.reconciliation_summary(tables.reconciled(spark, d), tables.decided_groups(spark, d))


@query(
    "clm12_policy_warnings",
    claim_oracle(
        """SELECT trip_id, warning_id, CASE WHEN done THEN 'approved by phone' ELSE '' END AS exception_note, done AS resolved
FROM (SELECT *, warning_id LIKE 'category:%' AND substr(warning_id, 18, 1) IN ('1', '5') AS done FROM policy)""",
        POLICY_SQL,
    ),
)
def _(spark, d):
    """Exceptions are documented for the category of every fifth receipt; some notes are blank."""
    digit = F.substring("source_file", 9, 1)
    given = view(spark, d, "receipts").filter(digit.isin("1", "3", "5")).select(
        "trip_id", F.concat(F.lit("category:"), "source_file").alias("k"), F.when(digit == "3", F.lit("  ")).otherwise(F.lit(" approved by phone ")).alias("v")
    )
    noted = given.groupBy("trip_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("noted"))
    trips = _policy_trips(spark, d).join(noted, "trip_id", "left").withColumn("policy_exceptions", F.coalesce("noted", "policy_exceptions")).drop("noted")
    return claims.policy_warnings(
        tables.reconciled(spark, d), view(spark, d, "matched_groups"), view(spark, d, "allocations"), trips
    ).select("trip_id", "warning_id", "exception_note", "resolved")


@query(
    "clm11_unmatched",
    claim_oracle(
        """SELECT 'receipt' AS kind, trip_id, source_file AS id FROM reconciled WHERE group_count = 0
UNION ALL SELECT 'group', trip_id, group_id FROM dec4 WHERE match_eligible AND NOT ignored AND matched_file IS NULL AND allocation_status = 'none'"""
    ),
)
def _(spark, d):
    r = claims.unmatched_receipts(tables.reconciled(spark, d))
    g = claims.unmatched_groups(tables.decided_groups(spark, d))
    return r.select(F.lit("receipt").alias("kind"), "trip_id", F.col("source_file").alias("id")).unionByName(
        g.select(F.lit("group").alias("kind"), "trip_id", F.col("group_id").alias("id"))
    )
