"""Queries of report tables, the manifest and the remaining sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize, scratch_path
from tripledger.operators import claims, lines, manifest, reports
from tripledger.plans import tables
from tripledger.plans.bindings import oracle, view
from tripledger.plans.oracle_parts import cents, half_up, money
from tripledger.plans.q_claims import claim_oracle
from tripledger.plans.q_matching import PARTS as MATCH_PARTS
from tripledger.plans.registry import query
from tripledger.sources import tables as source

SHARE = money(half_up(cents("coalesce(amount, 0)"), "number_of_people"))
SPONSOR = f""", sponsor AS (
  SELECT r.trip_id, r.source_file, CASE WHEN anyout AND kept > 0 THEN {money(half_up(cents("kept"), "number_of_people"))} ELSE {money(half_up(cents("coalesce(r.amount, 0)"), "number_of_people"))} END AS original_claim,
         CASE WHEN in_company AND NOT in_sponsor THEN CAST(0 AS DECIMAL(18,2)) ELSE {money(half_up(cents("coalesce(alc, 0)"), "number_of_people"))} END AS removed_alcohol,
         CASE WHEN in_company AND NOT in_sponsor THEN {money(half_up(cents("coalesce(r.amount, 0)"), "number_of_people"))} ELSE {money(half_up(cents("coalesce(oth, 0)"), "number_of_people"))} END AS removed_other
  FROM receipts r LEFT JOIN (SELECT trip_id, source_file, bool_or(NOT in_sponsor) AS anyout, sum(amount) FILTER (in_sponsor) AS kept,
       sum(amount) FILTER (NOT in_sponsor AND is_alcohol) AS alc, sum(amount) FILTER (NOT in_sponsor AND NOT is_alcohol) AS oth FROM lines_prog GROUP BY 1, 2) s
    ON s.trip_id = r.trip_id AND s.source_file = r.source_file)"""


def _expenses(spark, d):
    return materialize(tables.expenses(spark, d))


def _expenses_and_lines(spark, d):
    """Expenses and the program lines they come from, both written once."""
    rows = materialize(tables.program_lines(spark, d))
    return materialize(tables.expenses(spark, d, rows)), rows


def _with_sponsor(spark, d):
    """Expenses, and the sponsor's amounts from the same written lines."""
    e, rows = _expenses_and_lines(spark, d)
    return e, lines.sponsor_amounts(rows, view(spark, d, "receipts"))


@query(
    "rpt1_expense_report",
    claim_oracle(
        f"""SELECT trip_id, source_file, amount AS full_receipt, {SHARE} AS traveller_share, total_cad, reimbursable_cad, sponsor_claim_cad, 'receipt' AS row_kind FROM expenses
UNION ALL SELECT trip_id, NULL, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)), CAST(sum({SHARE}) AS DECIMAL(18,2)), CAST(coalesce(sum(total_cad), 0) AS DECIMAL(18,2)), CAST(coalesce(sum(reimbursable_cad), 0) AS DECIMAL(18,2)),
       CAST(sum(sponsor_claim_cad) AS DECIMAL(18,2)), 'total' FROM expenses GROUP BY 1"""
    ),
)
def _(spark, d):
    return reports.expense_report(_expenses(spark, d)).select(
        "trip_id", "source_file", "full_receipt", "traveller_share", "total_cad", "reimbursable_cad", "sponsor_claim_cad", "row_kind"
    )


@query(
    "rpt2_accounting_rows",
    claim_oracle(
        """SELECT j.trip_id, CASE WHEN claim_program = 'sponsored' THEN 'Record traveller expenses' ELSE 'Record expense report' END AS step, amount_cad FROM journal j JOIN trips t ON t.trip_id = j.trip_id
UNION ALL SELECT s.trip_id, 'Pay traveller', reimbursement_total_cad FROM summary s JOIN trips t ON t.trip_id = s.trip_id WHERE claim_program <> 'sponsored'
UNION ALL SELECT s.trip_id, 'Invoice sponsor', sponsor_claim_total_cad FROM summary s JOIN trips t ON t.trip_id = s.trip_id WHERE claim_program = 'sponsored'
UNION ALL SELECT s.trip_id, 'Receive sponsor reimbursement', sponsor_claim_total_cad FROM summary s JOIN trips t ON t.trip_id = s.trip_id WHERE claim_program = 'sponsored'"""
    ),
)
def _(spark, d):
    e = _expenses(spark, d)
    return reports.accounting_rows(claims.journal(e), claims.claim_summary(e), view(spark, d, "trips")).select(
        "trip_id", "step", "amount_cad"
    )


@query(
    "rpt3_card_statement_audit",
    claim_oracle(
        f"""SELECT trip_id, source_file, group_id, CAST(sh + CASE WHEN last = 1 AND w > 0 THEN sponsor_claim_cad - sum(sh) OVER (PARTITION BY trip_id, source_file) ELSE 0 END AS DECIMAL(18,2)) AS allocated_claim_cad
FROM (SELECT *, CASE WHEN w <= 0 THEN CASE WHEN first = 1 THEN sponsor_claim_cad ELSE CAST(0 AS DECIMAL(18,2)) END ELSE {money(half_up(f"({cents('sponsor_claim_cad')} * {cents('wt')})", f"greatest({cents('w')}, 1)"))} END AS sh
  FROM (SELECT e.trip_id, e.source_file, g.group_id, e.sponsor_claim_cad, abs(coalesce(g.cad_amount, 0)) AS wt, sum(abs(coalesce(g.cad_amount, 0))) OVER (PARTITION BY e.trip_id, e.source_file) AS w,
        row_number() OVER (PARTITION BY e.trip_id, e.source_file ORDER BY g.group_id DESC) AS last, row_number() OVER (PARTITION BY e.trip_id, e.source_file ORDER BY g.group_id) AS first
        FROM expenses e JOIN dec4 g ON g.trip_id = e.trip_id AND g.matched_file = e.source_file))"""
    ),
)
def _(spark, d):
    return reports.card_statement_audit(_expenses(spark, d), tables.decided_groups(spark, d)).select(
        "trip_id", "source_file", "group_id", "allocated_claim_cad"
    )


@query(
    "rpt4_receipt_reconciliation",
    claim_oracle(
        f"""SELECT e.trip_id, e.source_file, {SHARE} AS traveller_share, total_cad, CASE WHEN coalesce(total_cad, 0) <> 0 AND {SHARE} <> 0 THEN CAST(CAST(total_cad AS DOUBLE) / CAST({SHARE} AS DOUBLE) AS DECIMAL(18,6)) END AS effective_rate,
       original_claim AS eligible_original, removed_alcohol FROM expenses e JOIN sponsor s ON s.trip_id = e.trip_id AND s.source_file = e.source_file""",
        SPONSOR,
    ),
)
def _(spark, d):
    return reports.receipt_reconciliation(*_with_sponsor(spark, d)).select(
        "trip_id", "source_file", "traveller_share", "total_cad", "effective_rate", "eligible_original", "removed_alcohol"
    )


_PART = money(half_up(f"({cents('sponsor_excluded_cad')} * {cents('removed_share')})", f"greatest({cents('w')}, 1)"))


@query(
    "rpt5_line_audit",
    claim_oracle(
        f"""SELECT trip_id, source_file, pos, removed_share, CAST(CASE WHEN NOT removed THEN 0 ELSE sh + CASE WHEN last = 1 AND w > 0 THEN sponsor_excluded_cad - given ELSE 0 END END AS DECIMAL(18,2)) AS removed_cad
FROM (SELECT *, sum(sh) OVER (PARTITION BY trip_id, source_file) AS given FROM (
  SELECT *, CASE WHEN w <= 0 THEN CASE WHEN first = 1 THEN sponsor_excluded_cad ELSE CAST(0 AS DECIMAL(18,2)) END ELSE {_PART} END AS sh FROM (
    SELECT *, sum(removed_share) OVER (PARTITION BY trip_id, source_file) AS w, row_number() OVER (PARTITION BY trip_id, source_file ORDER BY pos DESC) AS last,
           row_number() OVER (PARTITION BY trip_id, source_file ORDER BY pos) AS first FROM (
      SELECT e.trip_id, e.source_file, l.pos, NOT l.in_sponsor AS removed, e.sponsor_excluded_cad,
             CASE WHEN NOT l.in_sponsor THEN {money(half_up(cents("l.amount"), "e.number_of_people"))} ELSE CAST(0 AS DECIMAL(18,2)) END AS removed_share
      FROM expenses e JOIN lines_prog l ON l.trip_id = e.trip_id AND l.source_file = e.source_file WHERE abs(l.amount) >= 0.005
      UNION ALL
      SELECT trip_id, source_file, 0, in_company AND NOT in_sponsor, sponsor_excluded_cad, CASE WHEN in_company AND NOT in_sponsor THEN {SHARE} ELSE CAST(0 AS DECIMAL(18,2)) END
      FROM expenses e WHERE NOT EXISTS (SELECT 1 FROM lines_prog l WHERE l.trip_id = e.trip_id AND l.source_file = e.source_file AND abs(l.amount) >= 0.005)))))"""
    ),
)
def _(spark, d):
    return reports.line_audit(*_expenses_and_lines(spark, d)).select(
        "trip_id", "source_file", "pos", "removed_share", "removed_cad"
    )


_G = "CAST(coalesce(gst_hst, 0) * 100 AS HUGEINT)"
_Q = "CAST(coalesce(qst, 0) * 100 AS HUGEINT)"
_F = "CAST(coalesce(fx_rate, CASE WHEN currency = 'CAD' THEN 1 ELSE 0 END) * 1000000 AS HUGEINT)"


def _tax(name: str) -> str:
    return money(half_up(f"({name} * {_F} * {cents('original_claim')})", f"(1000000 * greatest({cents('coalesce(amount, 0)')}, 1))"))


@query(
    "rpt6_sponsor_form_rows",
    claim_oracle(
        f"""SELECT trip_id, source_file, claim_cad, category, gst, qst, hst, CAST(greatest(0, claim_cad - gst - qst - hst) AS DECIMAL(18,2)) AS category_cad FROM (
  SELECT *, CAST(CASE WHEN hst_area THEN 0 ELSE least(greatest(0, claim_cad - gst), q0) END AS DECIMAL(18,2)) AS qst FROM (
   SELECT *, CAST(CASE WHEN hst_area THEN least(claim_cad, g0) ELSE 0 END AS DECIMAL(18,2)) AS hst, CAST(CASE WHEN hst_area THEN 0 ELSE least(claim_cad, g0) END AS DECIMAL(18,2)) AS gst FROM (
    SELECT e.trip_id, e.source_file, sponsor_claim_cad AS claim_cad, province = 'ON' AS hst_area,
           CASE expense_type WHEN 'meal' THEN 'meal' WHEN 'other' THEN 'other' ELSE 'travel' END AS category,
           CASE WHEN (country = 'Canada' OR (country = '' AND (province <> '' OR currency = 'CAD'))) AND coalesce(amount, 0) > 0 THEN {_tax(_G)} ELSE CAST(0 AS DECIMAL(18,2)) END AS g0,
           CASE WHEN (country = 'Canada' OR (country = '' AND (province <> '' OR currency = 'CAD'))) AND coalesce(amount, 0) > 0 THEN {_tax(_Q)} ELSE CAST(0 AS DECIMAL(18,2)) END AS q0
    FROM expenses e JOIN sponsor s ON s.trip_id = e.trip_id AND s.source_file = e.source_file WHERE sponsor_claim_cad > 0)))""",
        SPONSOR,
    ),
)
def _(spark, d):
    return reports.sponsor_form_rows(*_with_sponsor(spark, d)).select(
        "trip_id", "source_file", "claim_cad", "category", "gst", "qst", "hst", "category_cad"
    )


@query(
    "rpt7_company_detail",
    claim_oracle(
        """SELECT trip_id, source_file, CAST(recoverable_gst AS DECIMAL(18,2)) AS recoverable_gst_cad, CAST(net_cad AS DECIMAL(18,2)) AS net_cad,
       CAST(net_cad * CASE WHEN expense_type = 'meal' THEN CAST(0.5 AS DECIMAL(2,1)) ELSE CAST(1 AS DECIMAL(2,1)) END AS DECIMAL(18,2)) AS deductible_cad FROM taxed"""
    ),
)
def _(spark, d):
    out = reports.company_detail(_expenses(spark, d))
    return out.filter("include and net_cad is not null").select(
        "trip_id", "source_file", "recoverable_gst_cad", "net_cad", "deductible_cad"
    )


@query(
    "rpt8_review_checks",
    claim_oracle(
        """, tax AS (SELECT trip_id, source_file, coalesce(country, '') IN ('', 'Canada') AND (
     (amount >= 100 AND gst_hst > 0 AND gst_hst_number = '') OR (amount >= 100 AND qst > 0 AND qst_number = '')
     OR (currency = 'CAD' AND amount >= 500 AND (purchaser_name = '' OR payment_terms = '' OR description = ''))) AS review FROM receipts),
counted AS (SELECT e.trip_id, CAST(coalesce(sum(CASE WHEN in_company THEN reimbursable_cad END), 0) AS DECIMAL(18,2)) AS reimbursement,
   count_if(in_company AND cad_amount_used IS NULL) AS no_cad,
   count_if(in_company AND manual_cad IS NULL AND NOT (cad_source LIKE 'statement%' OR cad_source LIKE 'allocation%')) AS no_match,
   count_if(in_company AND coalesce(t.review, false)) AS tax_warnings,
   count_if(in_company AND (amount IS NULL OR receipt_date IS NULL)) AS unread
   FROM expenses e JOIN tax t ON t.trip_id = e.trip_id AND t.source_file = e.source_file GROUP BY 1),
summed AS (SELECT c.*, CAST(coalesce(j.d, 0) AS DECIMAL(18,2)) AS debits FROM counted c
   LEFT JOIN (SELECT trip_id, sum(amount_cad) AS d FROM journal GROUP BY 1) j ON j.trip_id = c.trip_id)
SELECT trip_id, 'journal_debits' AS "check", debits AS value, '' AS status FROM summed
UNION ALL SELECT trip_id, 'reimbursement', reimbursement, '' FROM summed
UNION ALL SELECT trip_id, 'journal_difference', CAST(debits - reimbursement AS DECIMAL(18,2)), CASE WHEN abs(debits - reimbursement) < 0.01 THEN 'OK' ELSE 'REVIEW' END FROM summed
UNION ALL SELECT trip_id, 'missing_cad', CAST(no_cad AS DECIMAL(18,2)), CASE WHEN no_cad = 0 THEN 'OK' ELSE 'REVIEW' END FROM summed
UNION ALL SELECT trip_id, 'missing_match', CAST(no_match AS DECIMAL(18,2)), CASE WHEN no_match = 0 THEN 'OK' ELSE 'REVIEW' END FROM summed
UNION ALL SELECT trip_id, 'tax_documentation', CAST(tax_warnings AS DECIMAL(18,2)), CASE WHEN tax_warnings = 0 THEN 'OK' ELSE 'REVIEW' END FROM summed
UNION ALL SELECT trip_id, 'extraction', CAST(unread AS DECIMAL(18,2)), CASE WHEN unread = 0 THEN 'OK' ELSE 'REVIEW' END FROM summed"""
    ).replace("\n, tax AS", ", tax AS"),
)
def _(spark, d):
    e = _expenses(spark, d)
    documented = lines.tax_documentation(
        e.withColumn(
            "extraction_status", claims.extraction_status(F.col("amount"), F.col("currency"), F.col("receipt_date"), F.col("vendor"))
        )
    )
    out = reports.review_checks(e, claims.journal(e), documented)
    return out.select("trip_id", "check", "value", "status")


@query(
    "rpt9_allocation_rows",
    oracle(
        "matched_groups allocations receipts",
        """SELECT g.trip_id, g.group_id, 'raw' AS row_kind, cad_amount, CASE WHEN a.group_id IS NOT NULL THEN 'allocated_raw' ELSE match_status END AS row_status
FROM matched_groups g LEFT JOIN (SELECT DISTINCT trip_id, group_id FROM allocations) a ON a.trip_id = g.trip_id AND a.group_id = g.group_id
UNION ALL SELECT a.trip_id, a.group_id, 'allocation', a.cad_amount, CASE WHEN abs(g.cad_amount - sum(a.cad_amount) OVER (PARTITION BY a.trip_id, a.group_id)) <= 0.01 THEN 'balanced' ELSE 'review' END
FROM allocations a JOIN matched_groups g ON g.trip_id = a.trip_id AND g.group_id = a.group_id""",
    ),
)
def _(spark, d):
    return reports.allocation_rows(
        view(spark, d, "matched_groups"), view(spark, d, "allocations"), view(spark, d, "receipts")
    ).select("trip_id", "group_id", "row_kind", "cad_amount", "row_status")


@query(
    "rpt10_legacy_tables",
    claim_oracle(
        """SELECT r.trip_id, r.source_file, items, CASE WHEN amount IS NULL THEN 'missing' WHEN items IS NULL THEN 'receipt total used' WHEN abs(items - amount) <= greatest(0.05, amount * 0.03) THEN 'ok' ELSE 'mismatch' END AS amount_check
FROM receipts r LEFT JOIN (SELECT trip_id, source_file, CAST(sum(amount) FILTER (amount > 0) AS DECIMAL(18,2)) AS items FROM receipt_lines GROUP BY 1, 2) s ON s.trip_id = r.trip_id AND s.source_file = r.source_file"""
    ),
)
def _(spark, d):
    return reports.legacy_expense_list(view(spark, d, "receipts"), tables.program_lines(spark, d)).select(
        "trip_id", "source_file", "items", "amount_check"
    )


def _manifest(spark, d):
    e, rows = _expenses_and_lines(spark, d)
    receipts = manifest.manifest_receipts(e, rows)
    report = manifest.manifest_reports(claims.claim_summary(e), claims.journal(e), view(spark, d, "trips"), e)
    return receipts, report


@query(
    "man1_manifest_receipts",
    claim_oracle(
        """SELECT e.trip_id, e.source_file, concat('RCPT-', left(sha256(concat(e.trip_id, chr(0), e.source_file)), 20)) AS id, amount AS total, total_cad,
       CAST(coalesce(n, 0) AS INTEGER) AS line_count, claim_program = 'sponsored' AND in_sponsor AND in_company AS in_sponsor
FROM expenses e LEFT JOIN (SELECT trip_id, source_file, count(*) AS n FROM receipt_lines GROUP BY 1, 2) l ON l.trip_id = e.trip_id AND l.source_file = e.source_file"""
    ),
)
def _(spark, d):
    receipts, _ = _manifest(spark, d)
    return receipts.select("trip_id", "source_file", "id", "total", "total_cad", F.size("line_items").alias("line_count"), "in_sponsor")


@query(
    "man2_manifest_reports",
    claim_oracle(
        """SELECT s.trip_id, concat('TRIP-', s.trip_id) AS report_id, t.end_date AS report_date, reimbursement_total_cad, sponsor_claim_total_cad,
       CAST(coalesce((SELECT sum(amount_cad) FROM journal j WHERE j.trip_id = s.trip_id AND account_key = 'non_meal'), 0) AS DECIMAL(18,2)) AS travel_non_meal_cad
FROM summary s JOIN trips t ON t.trip_id = s.trip_id"""
    ),
)
def _(spark, d):
    _, report = _manifest(spark, d)
    return report.select(
        "trip_id", "report_id", "report_date", "reimbursement_total_cad", "sponsor_claim_total_cad",
        F.col("accounting_summary.travel_non_meal_cad").alias("travel_non_meal_cad"),
    )


@query(
    "man3_manifest_checks",
    claim_oracle(
        """SELECT rule, count(*) AS n FROM (
  SELECT 'total_missing' AS rule FROM expenses WHERE amount IS NULL UNION ALL SELECT 'total_cad_missing' FROM expenses WHERE total_cad IS NULL
  UNION ALL SELECT 'paid_by' FROM expenses WHERE paid_by = 'sponsor' UNION ALL SELECT 'document_date' FROM expenses WHERE receipt_date IS NULL
  UNION ALL SELECT 'components' FROM summary s JOIN trips t ON t.trip_id = s.trip_id WHERE abs(coalesce((SELECT sum(amount_cad) FROM journal j WHERE j.trip_id = s.trip_id AND account_key <> 'expenses_recoverable_from_clients'), 0)
     - reimbursement_total_cad + CASE WHEN claim_program = 'sponsored' THEN coalesce((SELECT sum(sponsor_claim_cad) FROM expenses e WHERE e.trip_id = s.trip_id AND paid_by = 'traveller_personal'), 0) ELSE 0 END) > 0.02)
GROUP BY 1"""
    ),
)
def _(spark, d):
    receipts, report = _manifest(spark, d)
    return manifest.manifest_checks(receipts, report).groupBy("rule").agg(F.count("*").alias("n"))


def _written_manifest(spark, d):
    path = scratch_path(spark)
    source.write_manifest(*_manifest(spark, d), path)
    return source.read_manifest(spark, path)


@query("src9_manifest_source", claim_oracle("SELECT coalesce(vendor, '') AS vendor, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM expenses GROUP BY 1"))
def _(spark, d):
    """Receipt records of a written manifest, by vendor."""
    receipts, _reports = _written_manifest(spark, d)
    return (
        receipts.select(F.get_json_object("value", "$.vendor").alias("vendor"), F.get_json_object("value", "$.total").cast("decimal(18,2)").alias("total"))
        .groupBy(F.coalesce("vendor", F.lit("")).alias("vendor"))
        .agg(F.count("*").alias("n"), F.sum("total").cast("decimal(18,2)").alias("total"))
    )


@query(
    "snk1_manifest_sink",
    claim_oracle("SELECT 'receipt' AS kind, count(*) AS n FROM expenses UNION ALL SELECT 'trip_report', count(*) FROM summary"),
)
def _(spark, d):
    """Manifest lines written and read back by kind."""
    r, t = _written_manifest(spark, d)
    return r.select(F.lit("receipt").alias("kind")).unionByName(t.select(F.lit("trip_report").alias("kind"))).groupBy("kind").agg(
        F.count("*").alias("n")
    )


@query("snk2_table_sinks", claim_oracle("SELECT trip_id, reviewed_total_cad FROM summary"))
def _(spark, d):
    target = source.write_report(
        claims.claim_summary(tables.expenses(spark, d)), scratch_path(spark), "run-1"
    )
    return spark.read.parquet(target).select("trip_id", "reviewed_total_cad")


@query("src6_fx_observation_source", oracle("fx_observations", "SELECT currency, obs_date, cad_per_unit FROM fx_observations"))
def _(spark, d):
    obs = view(spark, d, "fx_observations")
    payload = F.to_json(
        F.struct(
            F.array(
                F.create_map(
                    F.lit("d"), F.col("obs_date").cast("string"),
                    F.concat(F.lit("FX"), F.col("currency"), F.lit("CAD")), F.to_json(F.struct(F.col("cad_per_unit").cast("string").alias("v"))),
                )
            ).alias("observations")
        )
    )
    return source.fx_observations(obs.select(payload.alias("value")))


@query(
    "src7_receipt_text_source",
    "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'text' END AS method FROM conversations",
)
def _(spark, d):
    from tripledger.plans.bindings import table

    raw = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("trip_id"), F.col("turn").cast("string").alias("source_file"), F.col("text").alias("raw_text")
    )
    return source.receipt_texts(raw).select(
        F.col("trip_id").cast("bigint").alias("conv_id"), F.col("source_file").cast("bigint").alias("turn"), "method"
    )


@query(
    "src8_decision_source",
    oracle(
        "manual_matches dispositions",
        """SELECT 'manual' AS decision, trip_id, group_id, source_file AS value FROM manual_matches
UNION ALL SELECT 'disposition', trip_id, group_id, action FROM dispositions WHERE action IN ('keep', 'ignore')""",
    ),
)
def _(spark, d):
    """One JSON state per decision row, parsed back into decision tables."""
    manual = view(spark, d, "manual_matches").select(
        F.to_json(
            F.struct("trip_id", F.create_map("group_id", "source_file").alias("manual_matches")), {"ignoreNullFields": "false"}
        ).alias("value")
    )
    act = view(spark, d, "dispositions").select(
        F.to_json(
            F.struct("trip_id", F.create_map("group_id", F.struct("action", "note", F.col("updated_at").cast("string").alias("updated_at"))).alias("transaction_decisions"))
        ).alias("value")
    )
    t = source.decision_tables(manual.unionByName(act))
    m = t["manual_matches"].select(F.lit("manual").alias("decision"), "trip_id", "group_id", F.col("source_file").alias("value"))
    a = t["dispositions"].select(F.lit("disposition").alias("decision"), "trip_id", "group_id", F.col("action").alias("value"))
    return m.unionByName(a)


@query(
    "trip_cad_cost",
    oracle(
        "receipts statement_legs fx_observations",
        """SELECT r.trip_id, count(*) AS receipt_count, count(m.cad) AS matched_count, CAST(coalesce(sum(coalesce(m.cad, CASE WHEN m.n IS NULL AND r.currency = 'CAD' THEN r.amount END)), 0) AS DECIMAL(18,2)) AS cad_cost
FROM receipts r LEFT JOIN (SELECT trip_id, matched_file, count(*) AS n, CASE WHEN count_if(cad_completeness <> 'complete') = 0 THEN sum(cad_amount) END AS cad
   FROM matched WHERE matched_file IS NOT NULL GROUP BY 1, 2) m ON m.trip_id = r.trip_id AND m.matched_file = r.source_file GROUP BY 1""",
        MATCH_PARTS,
    ),
)
def _(spark, d):
    """Flagship: CAD cost of every receipt from its matched card charges, summed per trip."""
    _, matched = tables.matched_groups(spark, d)
    receipts = view(spark, d, "receipts").withColumn("manual_cad", F.lit(None).cast("decimal(18,2)"))
    groups = matched.withColumns({"ignored": F.lit(False), "allocation_status": F.lit("none")})
    totals = claims.receipt_cad_totals(groups, view(spark, d, "allocations").filter(F.lit(False)), receipts)
    costed = claims.cad_source(receipts, totals)
    return costed.groupBy("trip_id").agg(
        F.count("*").alias("receipt_count"),
        F.count_if(F.col("cad_source").isin(claims.STATEMENT_SOURCES)).alias("matched_count"),
        F.coalesce(F.sum("cad_amount_used"), F.lit(0)).cast("decimal(18,2)").alias("cad_cost"),
    )
