"""Queries of reviewer decisions, incremental scope and statement coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.operators import coverage, decisions, matching
from tripledger.plans.bindings import oracle, view
from tripledger.plans.registry import query

MG = "trip_id, group_id, matched_file, suggested_file, match_status, match_confidence, review_reason"

DEC1 = """kept_manual AS (
  SELECT m.* FROM manual_matches m
  WHERE EXISTS (SELECT 1 FROM matched_groups g WHERE g.trip_id = m.trip_id AND g.group_id = m.group_id)
    AND (m.source_file IS NULL OR EXISTS (SELECT 1 FROM receipts r WHERE r.trip_id = m.trip_id AND r.source_file = m.source_file))),
dec1 AS (
  SELECT g.* EXCLUDE (matched_file, suggested_file, match_status, match_confidence, review_reason),
         m.group_id IS NOT NULL AS override_active,
         CASE WHEN m.group_id IS NOT NULL AND match_eligible THEN m.source_file ELSE matched_file END AS matched_file,
         CASE WHEN m.source_file IS NOT NULL AND match_eligible THEN m.source_file ELSE suggested_file END AS suggested_file,
         CASE WHEN NOT match_eligible OR m.group_id IS NULL THEN match_status WHEN m.source_file IS NOT NULL THEN 'manual' ELSE 'unmatched' END AS match_status,
         CASE WHEN match_eligible AND m.source_file IS NOT NULL THEN CAST(1 AS DECIMAL(6,3)) ELSE match_confidence END AS match_confidence,
         CASE WHEN match_eligible AND m.group_id IS NOT NULL THEN '' ELSE review_reason END AS review_reason
  FROM matched_groups g LEFT JOIN kept_manual m ON m.trip_id = g.trip_id AND m.group_id = g.group_id)"""

DEC2 = """dec2 AS (
  SELECT g.* EXCLUDE (matched_file, match_status, match_confidence, normalization_status),
         coalesce(act = 'ignore', false) AS ignored,
         CASE WHEN act = 'ignore' THEN NULL WHEN act = 'keep' AND matched_file IS NULL AND suggested_file IS NOT NULL AND match_confidence >= 0.72 AND review_reason = ''
              THEN suggested_file ELSE matched_file END AS matched_file,
         CASE WHEN act = 'ignore' THEN 'ignored' WHEN act = 'keep' AND matched_file IS NULL AND suggested_file IS NOT NULL AND match_confidence >= 0.72 AND review_reason = ''
              THEN 'auto' ELSE match_status END AS match_status,
         CASE WHEN act = 'ignore' THEN CAST(0 AS DECIMAL(6,3)) ELSE match_confidence END AS match_confidence,
         CASE WHEN act = 'ignore' THEN 'ignored' WHEN act = 'keep' THEN 'duplicate_confirmed' ELSE normalization_status END AS normalization_status,
         coalesce(act, CASE WHEN normalization_status = 'possible_duplicate' THEN 'unresolved' END) AS duplicate_resolution,
         CASE WHEN act = 'ignore' THEN concat(CASE WHEN normalization_status = 'possible_duplicate' THEN 'Ignored as duplicate: ' ELSE 'Excluded from this trip: ' END,
                   'seen Decision recorded ', strftime(dec_at, '%Y-%m-%dT%H:%M:%S'), '.')
              WHEN act = 'keep' THEN concat('Confirmed as a legitimate repeated transaction. Decision recorded ', strftime(dec_at, '%Y-%m-%dT%H:%M:%S'), '.') ELSE '' END AS decision_note
  FROM (SELECT m.*, d.updated_at AS dec_at, CASE WHEN d.action = 'ignore' THEN 'ignore' WHEN d.action = 'keep' AND m.normalization_status = 'possible_duplicate' THEN 'keep' END AS act
        FROM {base} m LEFT JOIN dispositions d ON d.trip_id = m.trip_id AND d.group_id = m.group_id) g)"""

DEC4 = """dec4 AS (
  SELECT g.* EXCLUDE (matched_file, match_status, match_confidence),
         coalesce(total, CAST(0 AS DECIMAL(18,2))) AS allocation_total, status AS allocation_status,
         CASE WHEN total IS NULL THEN cad_amount WHEN status = 'balanced' THEN CAST(0 AS DECIMAL(18,2)) ELSE coalesce(cad_amount, 0) - total END AS allocation_balance,
         CASE WHEN total IS NULL THEN matched_file END AS matched_file,
         CASE WHEN total IS NULL THEN match_status ELSE 'split' END AS match_status,
         CASE WHEN total IS NULL THEN match_confidence WHEN status = 'balanced' THEN 1 ELSE 0 END AS match_confidence
  FROM (SELECT m.*, CAST(a.total AS DECIMAL(18,2)) AS total,
               CASE WHEN a.total IS NULL THEN 'none' WHEN abs(coalesce(cad_amount, 0) - a.total) <= 0.01 THEN 'balanced'
                    WHEN coalesce(cad_amount, 0) <> 0 AND (sign(a.total) * sign(cad_amount) < 0 OR abs(a.total) > abs(cad_amount)) THEN 'overallocated'
                    ELSE 'unallocated' END AS status
        FROM {base} m LEFT JOIN (SELECT trip_id, group_id, sum(cad_amount) AS total FROM allocations GROUP BY 1, 2) a
          ON a.trip_id = m.trip_id AND a.group_id = m.group_id) g)"""


@query("dec1_apply_manual_matches", oracle("matched_groups manual_matches receipts", f"SELECT {MG}, override_active FROM dec1", DEC1))
def _(spark, d):
    out = decisions.apply_manual_matches(
        view(spark, d, "matched_groups"), view(spark, d, "manual_matches"), view(spark, d, "receipts")
    )
    return out.select(*MG.split(", "), "override_active")


@query(
    "dec2_apply_dispositions",
    oracle(
        "matched_groups dispositions",
        f"SELECT {MG}, ignored, normalization_status, duplicate_resolution, decision_note FROM dec2",
        DEC2.format(base="matched_groups"),
    ),
)
def _(spark, d):
    out = decisions.apply_dispositions(view(spark, d, "matched_groups"), view(spark, d, "dispositions"))
    return out.select(*MG.split(", "), "ignored", "normalization_status", "duplicate_resolution", "decision_note")


@query(
    "dec3_validate_allocations",
    oracle(
        "allocations matched_groups receipts",
        """SELECT a.trip_id, a.group_id, allocation_id, type, a.source_file,
       CASE type WHEN 'personal' THEN 'Personal / non-reimbursable' ELSE '' END AS category, a.cad_amount,
       CASE WHEN coalesce(g.cad_amount, 0) <> 0 THEN CAST(round(CAST(abs(a.cad_amount) AS DOUBLE) / CAST(abs(g.cad_amount) AS DOUBLE) * 100, 4) AS DECIMAL(12,4)) ELSE CAST(0 AS DECIMAL(12,4)) END AS percentage,
       concat_ws('|', CASE WHEN type = 'gift' THEN 'invalid type' END, CASE WHEN a.source_file IS NOT NULL AND r.source_file IS NULL THEN 'invoice no longer present' END,
         CASE WHEN type IN ('purchase', 'refund') AND a.source_file IS NULL THEN 'must reference an invoice' END,
         CASE WHEN type = 'personal' AND note = '' THEN 'needs an audit note' END, CASE WHEN a.cad_amount = 0 THEN 'CAD amount cannot be zero' END,
         CASE WHEN type = 'refund' AND a.cad_amount > 0 THEN 'refund amount must be negative' END,
         CASE WHEN type <> 'refund' AND a.cad_amount < 0 THEN 'amount must be positive' END) AS errors
FROM allocations a LEFT JOIN matched_groups g ON g.trip_id = a.trip_id AND g.group_id = a.group_id
LEFT JOIN receipts r ON r.trip_id = a.trip_id AND r.source_file = a.source_file""",
    ),
)
def _(spark, d):
    out = decisions.validate_allocations(
        view(spark, d, "allocations"), view(spark, d, "matched_groups"), view(spark, d, "receipts")
    )
    return out.select(
        "trip_id", "group_id", "allocation_id", "type", "source_file", "category", "cad_amount", "percentage",
        F.array_join("errors", "|").alias("errors"),
    )


@query(
    "dec4_allocation_totals",
    oracle(
        "matched_groups allocations",
        "SELECT trip_id, group_id, matched_file, match_status, match_confidence, allocation_total, allocation_status, allocation_balance FROM dec4",
        DEC4.format(base="matched_groups"),
    ),
)
def _(spark, d):
    out = decisions.allocation_totals(view(spark, d, "matched_groups"), view(spark, d, "allocations"))
    return out.select(
        "trip_id", "group_id", "matched_file", "match_status", "match_confidence", "allocation_total",
        "allocation_status", "allocation_balance",
    )


DEC5 = """edited AS (
  SELECT r.* EXCLUDE (vendor, amount), CASE WHEN v.field IS NOT NULL THEN v.value ELSE r.vendor END AS vendor,
         CASE WHEN a.field IS NOT NULL THEN CAST(a.value AS DECIMAL(18,2)) ELSE r.amount END AS amount
  FROM receipts r LEFT JOIN field_edits v ON v.trip_id = r.trip_id AND v.source_file = r.source_file AND v.field = 'vendor'
  LEFT JOIN field_edits a ON a.trip_id = r.trip_id AND a.source_file = r.source_file AND a.field = 'amount')"""


@query(
    "dec5_apply_invoice_overrides",
    oracle(
        "receipts field_edits",
        """SELECT trip_id, source_file, vendor, amount,
       concat(coalesce(strftime(receipt_date, '%Y%m%d'), 'yyyymmdd'), '_#',
              CAST(row_number() OVER (PARTITION BY trip_id ORDER BY lower(source_file), source_file) AS VARCHAR)) AS expense_id
FROM edited""",
        DEC5,
    ),
)
def _(spark, d):
    edited = decisions.apply_field_overrides(
        view(spark, d, "receipts"), view(spark, d, "field_edits"), ["vendor", "amount"]
    )
    return decisions.issue_expense_ids(edited).select("trip_id", "source_file", "vendor", "amount", "expense_id")


@query(
    "dec6_statement_basis",
    oracle(
        "receipts basis",
        """SELECT r.trip_id, r.source_file, CASE WHEN basis = 'full_receipt' OR number_of_people > 1 THEN basis END AS explicit_basis, b.updated_at AS basis_updated_at
FROM receipts r LEFT JOIN basis b ON b.trip_id = r.trip_id AND b.source_file = r.source_file""",
    ),
)
def _(spark, d):
    return decisions.statement_basis(view(spark, d, "receipts"), view(spark, d, "basis")).select(
        "trip_id", "source_file", "explicit_basis", "basis_updated_at"
    )


@query(
    "dec7_removed_receipt_cascade",
    oracle(
        "receipts manual_matches allocations",
        """SELECT 'manual' AS decision, trip_id, group_id, source_file FROM manual_matches m
WHERE source_file IS NULL OR EXISTS (SELECT 1 FROM receipts r WHERE r.trip_id = m.trip_id AND r.source_file = m.source_file AND r.expense_type <> 'meal')
UNION ALL SELECT 'allocation', trip_id, group_id, source_file FROM allocations m
WHERE source_file IS NULL OR EXISTS (SELECT 1 FROM receipts r WHERE r.trip_id = m.trip_id AND r.source_file = m.source_file AND r.expense_type <> 'meal')""",
    ),
)
def _(spark, d):
    present = view(spark, d, "receipts").filter("expense_type <> 'meal'")
    out = None
    for name, table in (("manual", "manual_matches"), ("allocation", "allocations")):
        part = decisions.removed_receipt_cascade(view(spark, d, table), present).select(
            F.lit(name).alias("decision"), "trip_id", "group_id", "source_file"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "dec8_refresh_receipt_snapshot",
    oracle(
        "receipts field_edits",
        """SELECT r.trip_id, r.source_file, e.vendor, e.amount, (e.amount IS DISTINCT FROM r.amount) AS estimate_void
FROM receipts r JOIN edited e ON e.trip_id = r.trip_id AND e.source_file = r.source_file""",
        DEC5,
    ),
)
def _(spark, d):
    receipts = view(spark, d, "receipts")
    edited = decisions.apply_field_overrides(receipts, view(spark, d, "field_edits"), ["vendor", "amount"])
    out, _ = decisions.refresh_snapshot(receipts, edited, receipts.select("trip_id", "source_file"))
    return out.select("trip_id", "source_file", "vendor", "amount", "estimate_void")


INC1 = """protected AS (
  SELECT trip_id, group_id FROM matched_groups WHERE matched_file IS NOT NULL
  UNION SELECT trip_id, group_id FROM allocations UNION SELECT trip_id, group_id FROM manual_matches
  UNION SELECT trip_id, group_id FROM dispositions WHERE action = 'ignore'),
taken AS (
  SELECT trip_id, matched_file AS source_file FROM matched_groups UNION SELECT trip_id, source_file FROM allocations
  UNION SELECT trip_id, source_file FROM manual_matches)"""


@query(
    "inc1_incremental_scope",
    oracle(
        "receipts matched_groups allocations manual_matches dispositions",
        """SELECT 'group' AS kind, trip_id, group_id AS id FROM matched_groups g WHERE NOT EXISTS (SELECT 1 FROM protected p WHERE p.trip_id = g.trip_id AND p.group_id = g.group_id)
UNION ALL SELECT 'receipt', trip_id, source_file FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.trip_id = r.trip_id AND t.source_file = r.source_file)""",
        INC1,
    ),
)
def _(spark, d):
    groups, receipts = matching.incremental_scope(
        view(spark, d, "matched_groups"),
        view(spark, d, "receipts"),
        view(spark, d, "manual_matches"),
        view(spark, d, "allocations"),
        view(spark, d, "dispositions"),
    )
    return groups.select(F.lit("group").alias("kind"), "trip_id", F.col("group_id").alias("id")).unionByName(
        receipts.select(F.lit("receipt").alias("kind"), "trip_id", F.col("source_file").alias("id"))
    )


COV = (
    DEC2.format(base="matched_groups")
    + """, file_ranges AS (
  SELECT g.trip_id, g.provider, g.account_label, f.source_file, min(transaction_date) AS s, max(transaction_date) AS e
  FROM dec2 g JOIN group_files f ON f.trip_id = g.trip_id AND f.group_id = g.group_id GROUP BY 1, 2, 3, 4),
cov AS (
  SELECT g.trip_id, g.provider, g.account_label, concat(upper(g.provider), ' ', g.account_label) AS label, min(transaction_date) AS earliest_date, max(transaction_date) AS latest_date,
         count(*) AS transaction_count, count_if(match_eligible AND NOT ignored) AS match_eligible_count,
         coalesce(count_if(duplicate_resolution = 'unresolved'), 0) AS unresolved_duplicate_count,
         (SELECT count(*) FROM file_ranges r WHERE r.trip_id = g.trip_id AND r.provider = g.provider AND r.account_label = g.account_label) AS file_count,
         EXISTS (SELECT 1 FROM file_ranges a JOIN file_ranges b ON a.trip_id = b.trip_id AND a.provider = b.provider AND a.account_label = b.account_label
                 AND a.source_file < b.source_file AND a.s <= b.e AND b.s <= a.e
                 WHERE a.trip_id = g.trip_id AND a.provider = g.provider AND a.account_label = g.account_label) AS overlapping_files
  FROM dec2 g GROUP BY 1, 2, 3, 4),
expected AS (SELECT trip_id, unnest(['AMEX card-1', 'visa']) AS account FROM trips),
gaps AS (
  SELECT trip_id, 'missing_expected_account' AS code FROM expected x
  WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.trip_id = x.trip_id AND lower(x.account) IN (lower(c.label), lower(c.account_label), lower(c.provider)))
  UNION ALL SELECT trip_id, 'overlapping_exports' FROM cov WHERE overlapping_files AND unresolved_duplicate_count > 0
  UNION ALL SELECT trip_id, 'missing_account_dates' FROM cov WHERE earliest_date IS NULL
  UNION ALL SELECT c.trip_id, 'no_trip_overlap' FROM cov c JOIN trips t ON t.trip_id = c.trip_id WHERE latest_date < t.start_date - 5 OR earliest_date > t.end_date + 5
  UNION ALL SELECT c.trip_id, 'coverage_starts_late' FROM cov c JOIN trips t ON t.trip_id = c.trip_id WHERE NOT (latest_date < t.start_date - 5 OR earliest_date > t.end_date + 5) AND earliest_date > t.start_date - 5
  UNION ALL SELECT c.trip_id, 'coverage_ends_early' FROM cov c JOIN trips t ON t.trip_id = c.trip_id WHERE NOT (latest_date < t.start_date - 5 OR earliest_date > t.end_date + 5) AND latest_date < t.end_date + 5)"""
)
COV_IN = "trips matched_groups dispositions group_files"


def _coverage(spark, d):
    decided = decisions.apply_dispositions(view(spark, d, "matched_groups"), view(spark, d, "dispositions"))
    return coverage.statement_coverage(decided, view(spark, d, "group_files"))


def coverage_gaps(spark, d):
    trips = view(spark, d, "trips").withColumn("buffer_days", F.lit(5))
    expected = trips.select("trip_id", F.explode(F.array(F.lit("AMEX card-1"), F.lit("visa"))).alias("account"))
    return coverage.coverage_gaps(_coverage(spark, d), trips, expected)


@query("cov1_statement_coverage", oracle(COV_IN, "SELECT * FROM cov", COV))
def _(spark, d):
    return _coverage(spark, d)


@query("cov2_coverage_gaps", oracle(COV_IN, "SELECT trip_id, code, count(*) AS n FROM gaps GROUP BY 1, 2", COV))
def _(spark, d):
    return coverage_gaps(spark, d).groupBy("trip_id", "code").agg(F.count("*").alias("n"))


@query(
    "cov3_coverage_confirmation",
    oracle(
        COV_IN,
        """SELECT c.trip_id, TIMESTAMP '1998-01-01' AS confirmed_at, CASE WHEN t % 2 = 0 THEN 'ok' ELSE '' END AS note, coalesce(n.gap_count, 0) AS gap_count,
       coalesce(gap_count, 0) - CASE WHEN t % 3 = 1 THEN coalesce(early, 0) ELSE 0 END + CASE WHEN t % 5 = 0 THEN 1 ELSE 0 END AS confirmed_count,
       CASE WHEN coalesce(gap_count, 0) - CASE WHEN t % 3 = 1 THEN coalesce(early, 0) ELSE 0 END + CASE WHEN t % 5 = 0 THEN 1 ELSE 0 END > 0 AND t % 2 = 1 THEN 'note_required'
            WHEN ch.changed > TIMESTAMP '1998-01-01' THEN 'void_by_decision' WHEN t % 3 = 1 AND coalesce(early, 0) > 0 THEN 'void_by_new_gap'
            WHEN t % 5 = 0 THEN 'void_by_settled_gap' ELSE 'confirmed' END AS state
FROM conf c LEFT JOIN n USING (trip_id) LEFT JOIN ch USING (trip_id)""",
        COV
        + """, conf AS (SELECT trip_id, CAST(substr(trip_id, 2) AS INTEGER) AS t FROM trips),
n AS (SELECT trip_id, count(*) AS gap_count, count_if(code = 'coverage_ends_early') AS early FROM gaps GROUP BY 1),
ch AS (SELECT trip_id, max(updated_at) AS changed FROM dispositions GROUP BY 1)""",
    ),
)
def _(spark, d):
    """Confirmed were the gaps of now, in every third trip without those at the end, in every fifth with one that is settled since."""
    t = F.substring("trip_id", 2, 6).cast("int")
    at = F.lit("1998-01-01").cast("timestamp").alias("confirmed_at")
    confirmations = view(spark, d, "trips").select("trip_id", at, F.when(t % 2 == 0, F.lit("ok")).otherwise(F.lit("")).alias("note"))
    gaps = materialize(coverage_gaps(spark, d))
    then = gaps.filter((t % 3 != 1) | (F.col("code") != "coverage_ends_early")).select("trip_id", at, "code", "message")
    settled = confirmations.filter(t % 5 == 0).select("trip_id", "confirmed_at", F.lit("missing_account_dates").alias("code"), F.lit("settled since").alias("message"))
    changes = view(spark, d, "dispositions").select("trip_id", "updated_at")
    return coverage.coverage_confirmation(confirmations, then.unionByName(settled), gaps, changes)
