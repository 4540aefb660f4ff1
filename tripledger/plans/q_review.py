"""Queries of the review merge, exceptions, validation, lineage and extraction quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.operators import alcohol, claims, coverage, decisions, edits, lines, quality, review
from tripledger.plans import tables
from tripledger.plans.bindings import oracle, table, view
from tripledger.plans.q_claims import LINES, POLICY_SQL, claim_oracle
from tripledger.plans.q_decisions import COV, DEC2, DEC5, coverage_gaps
from tripledger.plans.registry import query

KEY = ["trip_id", "source_file"]
NOW = "1999-01-01"


def _ids(spark, d):
    return materialize(lines.line_ids(view(spark, d, "receipt_lines")))


def _stored(ids):
    """Reviewed lines of the numbered lines: every fourth line has its alcohol flag flipped by a reviewer."""
    return ids.filter("pos % 4 = 0").select(
        *KEY, "pos", "line_id", "description", "amount", (~F.col("is_alcohol")).alias("is_alcohol"), "in_sponsor",
        F.lit(False).alias("manual"), F.lit(False).alias("inclusion_overridden"), F.lit(True).alias("alcohol_overridden"), F.lit(True).alias("reviewed"),
    )


@query(
    "rev1_merge_rescan",
    oracle(
        "receipts receipt_lines",
        """SELECT l.trip_id, l.source_file, pos, CASE WHEN pos % 4 = 0 AND r.expense_type <> 'meal' THEN NOT is_alcohol ELSE is_alcohol END AS is_alcohol,
       pos % 4 = 0 AND r.expense_type <> 'meal' AS reviewed
FROM receipt_lines l JOIN receipts r ON r.trip_id = l.trip_id AND r.source_file = l.source_file WHERE NOT (pos % 5 = 1 AND r.expense_type <> 'meal')""",
    ),
)
def _(spark, d):
    new = _ids(spark, d)
    unchanged = view(spark, d, "receipts").filter("expense_type <> 'meal'")
    removed = new.filter("pos % 5 = 1").select(*KEY, "line_id")
    return review.merge_rescan(new, _stored(new), removed, unchanged).select(*KEY, "pos", "is_alcohol", "reviewed")


@query(
    "rev2_fuzzy_line_match",
    oracle("receipt_lines", "SELECT DISTINCT trip_id, source_file, pos AS new_pos, pos AS stored_pos FROM receipt_lines"),
)
def _(spark, d):
    rows = view(spark, d, "receipt_lines")
    return review.fuzzy_line_match(rows, rows).select(*KEY, "new_pos", "stored_pos")


@query(
    "rev3_preserve_decisions",
    oracle(
        "receipts receipt_lines",
        """SELECT trip_id, source_file, pos, description, CASE WHEN pos % 4 = 0 THEN NOT is_alcohol ELSE is_alcohol END AS is_alcohol, pos % 4 = 0 AS reviewed, false AS manual FROM receipt_lines
UNION ALL SELECT trip_id, source_file, 0, 'Added by hand', false, true, true FROM receipts""",
    ),
)
def _(spark, d):
    receipts = view(spark, d, "receipts")
    manual = receipts.select(
        *KEY, F.lit(0).cast("bigint").alias("pos"), F.lit("LI-manual-1").alias("line_id"), F.lit("Added by hand").alias("description"),
        F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit(False).alias("is_alcohol"), F.lit(True).alias("in_sponsor"), F.lit(True).alias("manual"),
        F.lit(False).alias("inclusion_overridden"), F.lit(False).alias("alcohol_overridden"), F.lit(True).alias("reviewed"),
    )
    new = _ids(spark, d)
    none = new.select(*KEY, "line_id").filter(F.lit(False))
    merged = review.merge_rescan(new, _stored(new).unionByName(manual), none, receipts)
    return merged.select(*KEY, "pos", "description", "is_alcohol", "reviewed", "manual")


@query(
    "rev4_extraction_changes",
    oracle(
        "receipts field_edits",
        """SELECT r.trip_id, r.source_file, 'vendor' AS field, true AS preserved_user_value FROM receipts r JOIN edited e ON e.trip_id = r.trip_id AND e.source_file = r.source_file WHERE lower(e.vendor) <> lower(r.vendor)
UNION ALL SELECT r.trip_id, r.source_file, 'amount', false FROM receipts r JOIN edited e ON e.trip_id = r.trip_id AND e.source_file = r.source_file
WHERE CASE WHEN e.amount IS NOT NULL AND r.amount IS NOT NULL THEN abs(e.amount - r.amount) > 0.01 ELSE (e.amount IS NULL) <> (r.amount IS NULL) END""",
        DEC5,
    ),
)
def _(spark, d):
    receipts, edits = view(spark, d, "receipts"), view(spark, d, "field_edits")
    edited = decisions.apply_field_overrides(receipts, edits, ["vendor", "amount"])
    return review.extraction_changes(receipts, edited, edits.filter("field = 'vendor'")).select(*KEY, "field", "preserved_user_value")


@query(
    "rev4_line_changes",
    oracle(
        "receipt_lines",
        """WITH_LISTS SELECT b.trip_id, b.source_file, 'line_items' AS field, coalesce(x.s, 'No extracted purchase lines') AS before, coalesce(y.s, 'No extracted purchase lines') AS after,
       b.trip_id LIKE '%7' AS preserved_user_value
FROM (SELECT DISTINCT trip_id, source_file FROM receipt_lines) b LEFT JOIN x ON x.trip_id = b.trip_id AND x.source_file = b.source_file
LEFT JOIN y ON y.trip_id = b.trip_id AND y.source_file = b.source_file WHERE x.l IS DISTINCT FROM y.l""".replace("WITH_LISTS ", ""),
        """later AS (SELECT trip_id, source_file,
    CASE WHEN substr(source_file, 8, 2) = '10' THEN -pos ELSE pos END AS pos, CASE WHEN substr(source_file, 9, 1) = '1' AND pos % 4 = 0 THEN concat(' edited  ', description) ELSE description END AS description,
    CASE WHEN substr(source_file, 9, 1) = '2' AND pos % 3 = 0 THEN NULL ELSE amount END AS amount, is_alcohol FROM receipt_lines WHERE NOT (substr(source_file, 9, 1) = '3' AND pos % 2 = 0)
  UNION ALL SELECT DISTINCT trip_id, source_file, 0, '', CAST(1 AS DECIMAL(18,2)), false FROM receipt_lines WHERE substr(source_file, 9, 1) = '4'),
shown AS (SELECT 'x' AS run, * FROM (SELECT trip_id, source_file, pos, description, amount, is_alcohol FROM receipt_lines) UNION ALL SELECT 'y', * FROM later),
lists AS (SELECT run, trip_id, source_file, string_agg(concat(CASE WHEN trim(description) = '' THEN 'Unnamed line' ELSE trim(regexp_replace(description, '\\s+', ' ', 'g')) END, ' — ',
    coalesce(CAST(amount AS VARCHAR), 'amount missing')), '; ' ORDER BY pos) AS s,
    list({'d': trim(regexp_replace(description, '\\s+', ' ', 'g')), 'a': amount, 'x': is_alcohol} ORDER BY pos) AS l FROM shown GROUP BY 1, 2, 3),
x AS (SELECT * FROM lists WHERE run = 'x'), y AS (SELECT * FROM lists WHERE run = 'y')""",
    ),
)
def _(spark, d):
    """A second extraction with some receipts in another order, edited, with amounts lost, lines lost or a line more."""
    before = materialize(view(spark, d, "receipt_lines").select(*KEY, "pos", "description", "amount", "is_alcohol"))
    digit = F.substring("source_file", 9, 1)
    pos = F.col("pos")
    after = before.filter(~((digit == "3") & (pos % 2 == 0))).select(
        *KEY, F.when(F.substring("source_file", 8, 2) == "10", -pos).otherwise(pos).alias("pos"),
        F.when((digit == "1") & (pos % 4 == 0), F.concat(F.lit(" edited  "), "description")).otherwise(F.col("description")).alias("description"),
        F.when(~((digit == "2") & (pos % 3 == 0)), F.col("amount")).alias("amount"), "is_alcohol",
    )
    more = before.filter(digit == "4").select(*KEY).distinct().select(
        *KEY, F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("description"), F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit(False).alias("is_alcohol")
    )
    decided = before.filter(F.col("trip_id").endswith("7"))
    return review.line_changes(before, after.unionByName(more), decided)


@query(
    "rev5_field_evidence",
    oracle(
        "receipts",
        """SELECT trip_id, source_file, 'amount' AS field, CASE WHEN amount IS NULL THEN 0.0 ELSE confidence END AS field_confidence FROM receipts
UNION ALL SELECT trip_id, source_file, 'qst', 1.0 FROM receipts
UNION ALL SELECT trip_id, source_file, 'province', CASE WHEN province = '' THEN 1.0 ELSE confidence END FROM receipts""",
    ),
)
def _(spark, d):
    return review.field_evidence(view(spark, d, "receipts")).filter("field in ('amount', 'qst', 'province')").select(
        *KEY, "field", "field_confidence"
    )


def _exceptions(spark, d):
    """Receipts, their totals and exceptions, from lines written once with their ids and alcohol evidence."""
    program = view(spark, d, "trips").select("trip_id", "claim_program")
    receipts = view(spark, d, "receipts").join(program, "trip_id").withColumn("reviewed", F.lit(False))
    ids = lines.line_ids(view(spark, d, "receipt_lines")).withColumn("given_alcohol", F.col("is_alcohol"))
    found = materialize(alcohol.detect_alcohol(ids))
    rows = found.withColumn("line_reviewed", F.lit(False)).withColumn("manual", F.lit(False))
    totals = lines.receipt_totals(lines.program_inclusion(found.withColumn("is_alcohol", F.col("given_alcohol"))), receipts)
    return receipts, totals, review.receipt_exceptions(receipts, review.field_evidence(receipts), rows, totals)


CATS = """exc AS (
  SELECT trip_id, source_file, 'missing_field' AS category, 'blocking' AS severity, (amount IS NULL)::INT + (receipt_date IS NULL)::INT AS n FROM receipts
  UNION ALL SELECT trip_id, source_file, 'low_confidence_field', 'review', CASE WHEN confidence < 0.72 THEN (receipt_date IS NOT NULL)::INT + 1 + (description <> '')::INT + 1 + (amount IS NOT NULL)::INT + 1 + (country <> '')::INT
       + (province <> '')::INT + 1 + (gst_hst_number <> '')::INT + (qst_number <> '')::INT ELSE 0 END FROM receipts
  UNION ALL SELECT l.trip_id, source_file, CASE WHEN claim_program = 'sponsored' AND description NOT IN ('Shiraz', 'Espresso martini', 'Ginger beer', 'Mocktail', 'GST') THEN 'uncertain_alcohol' WHEN confidence < 0.72 THEN 'low_confidence_line' END, 'review', 1
       FROM receipt_lines l JOIN trips t ON t.trip_id = l.trip_id WHERE line_type = 'item'
  UNION ALL SELECT l.trip_id, source_file, CASE WHEN confidence < 0.72 THEN 'low_confidence_line' END, 'review', 1 FROM receipt_lines l WHERE line_type = 'tax'
  UNION ALL SELECT trip_id, source_file, 'line_total_difference', CASE WHEN expense_type = 'meal' AND line_total - CASE WHEN claim_program = 'sponsored' THEN sponsor_included_total ELSE company_included_total END > 0.005 THEN 'blocking' ELSE 'review' END, 1
       FROM totals WHERE abs(line_total - amount) > 0.05),
exceptions AS (SELECT * FROM exc WHERE category IS NOT NULL AND n > 0)"""


@query(
    "rev6_receipt_exceptions",
    oracle(
        "receipts receipt_lines trips",
        "SELECT trip_id, category, severity, CAST(sum(n) AS BIGINT) AS n FROM exceptions GROUP BY 1, 2, 3",
        LINES + "," + CATS,
    ),
)
def _(spark, d):
    _, _, out = _exceptions(spark, d)
    return out.groupBy("trip_id", "category", "severity").agg(F.count("*").alias("n"))


def _with_copies(spark, d):
    receipts = view(spark, d, "receipts")
    return receipts.unionByName(receipts.withColumn("source_file", F.concat(F.lit("z-"), "source_file")))


@query(
    "rev7_duplicate_receipts",
    oracle(
        "receipts",
        """, x AS (SELECT trip_id, source_file, receipt_date, vendor, amount, currency FROM receipts UNION ALL SELECT trip_id, concat('z-', source_file), receipt_date, vendor, amount, currency FROM receipts)
SELECT trip_id, source_file, duplicate_of FROM (SELECT *, first_value(source_file) OVER w AS duplicate_of, row_number() OVER w AS rn FROM x WHERE amount IS NOT NULL AND receipt_date IS NOT NULL
  WINDOW w AS (PARTITION BY trip_id, receipt_date, vendor, amount, currency ORDER BY lower(source_file))) WHERE rn > 1""",
    ).replace("\n, x AS", ", x AS"),
)
def _(spark, d):
    return review.duplicate_receipts(_with_copies(spark, d))


@query(
    "rev8_review_summary",
    oracle(
        "receipts receipt_lines trips",
        """, pr AS (SELECT trip_id, source_file, coalesce(sum(n) FILTER (severity = 'blocking'), 0) AS b, coalesce(sum(n) FILTER (severity = 'review'), 0) AS v FROM exceptions GROUP BY 1, 2)
SELECT r.trip_id, count(*) AS receipt_count, count_if(coalesce(b, 0) > 0) AS blocking_receipts, count_if(coalesce(b, 0) = 0 AND coalesce(v, 0) > 0) AS review_receipts,
       count_if(coalesce(b, 0) = 0 AND coalesce(v, 0) = 0) AS ready_receipts,
       CAST(coalesce(sum(b), 0) AS BIGINT) AS exception_blocking_count, CAST(coalesce(sum(v), 0) AS BIGINT) AS exception_review_count
FROM receipts r LEFT JOIN pr ON pr.trip_id = r.trip_id AND pr.source_file = r.source_file GROUP BY 1""",
        LINES + "," + CATS,
    ).replace("\n, pr AS", ", pr AS"),
)
def _(spark, d):
    receipts, _, out = _exceptions(spark, d)
    return review.review_summary(receipts, out)


@query(
    "rev9_validate_receipts",
    oracle(
        "receipts",
        """SELECT trip_id, source_file, concat_ws('|', CASE WHEN coalesce(gst_hst, 0) + coalesce(qst, 0) > amount THEN 'tax above total' END, CASE WHEN manual_cad IS NOT NULL THEN 'manual CAD note' END) AS errors FROM receipts""",
    ),
)
def _(spark, d):
    return review.validate_receipts(view(spark, d, "receipts")).select(*KEY, F.array_join("errors", "|").alias("errors"))


@query(
    "rev10_apply_edits",
    oracle(
        "receipts field_edits",
        """SELECT r.trip_id, r.source_file, CASE WHEN r.expense_type = 'meal' THEN r.vendor ELSE e.vendor END AS vendor, CASE WHEN r.expense_type = 'meal' THEN r.amount ELSE e.amount END AS amount
FROM receipts r JOIN edited e ON e.trip_id = r.trip_id AND e.source_file = r.source_file""",
        DEC5,
    ),
)
def _(spark, d):
    receipts = view(spark, d, "receipts")
    sets = view(spark, d, "field_edits").select(*KEY, F.lit("set").alias("kind"), "field", "value", F.col("updated_at").alias("edited_at"))
    older = sets.withColumns({"value": F.lit("1.00"), "edited_at": F.col("edited_at") - F.expr("INTERVAL 1 DAY")})
    resets = receipts.filter("expense_type = 'meal'").select(
        *KEY, F.lit("reset").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"),
        F.lit("2030-01-01").cast("timestamp").alias("edited_at"),
    )
    return review.apply_edits(receipts, sets.unionByName(older).unionByName(resets)).select(*KEY, "vendor", "amount")


EDIT_COLUMNS = "trip_id string, source_file string, seq bigint, line_id string, kind string, field string, value string, description string, amount decimal(18,2), is_alcohol boolean, in_sponsor boolean"


def _edit_log(spark, d):
    """Every kind of event: line edits at 10 to 25, a reset at 22, removals at 30, a review at 35, restored lines at 40, lines by hand at 15 and 45."""
    k = F.substring("source_file", 2, 8).cast("int")
    rows = view(spark, d, "receipt_lines").filter("line_type = 'item'").withColumn("line_id", F.col("pos").cast("string"))
    receipts = view(spark, d, "receipts")

    def events(df, when, seq, kind, field=None, value=None, **more):
        values = {"field": F.lit(field), "value": F.lit(None) if value is None else value, "line_id": F.lit(None), **more}
        names = [c.split()[0] for c in EDIT_COLUMNS.split(", ")]
        given = {"seq": F.lit(seq) if isinstance(seq, int) else seq, "kind": F.lit(kind), **values}
        types = dict(c.split(" ", 1) for c in EDIT_COLUMNS.split(", "))
        return df.filter(when).select([F.col(n) if n in KEY else given.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names])

    pos = F.col("pos")
    line = {"line_id": F.col("line_id")}
    hand = {"description": F.lit("By  hand"), "amount": F.lit("3.00"), "is_alcohol": F.lit(True), "in_sponsor": F.lit(True)}
    parts = [
        events(rows, pos % 3 == 0, 10 + pos % 5, "set", "is_alcohol", (~F.col("is_alcohol")).cast("string"), **line),
        events(rows, pos % 4 == 0, 20, "set", "amount", F.lit("-5.00"), **line),
        events(rows, pos % 7 == 0, 25, "set", "description", F.lit("edited"), **line),
        events(rows, pos % 11 == 0, 26, "set", "in_sponsor", F.lit("false"), **line),
        events(rows, pos % 13 == 0, 27, "set", "description", F.lit("  "), **line),  # refused
        events(rows, pos % 5 == 0, 30, "remove", **line),
        events(rows, pos % 10 == 0, 40, "restore", **line),
        events(receipts, k % 8 == 0, 1, "set", "vendor", F.lit("First")),
        events(receipts, k % 10 == 0, 15, "add", line_id=F.lit("hand-1"), **hand),
        events(receipts, k % 6 == 0, 22, "reset"),
        events(receipts, k % 5 == 0, 35, "set", "reviewed", F.lit("true")),
        events(receipts, k % 15 == 0, 45, "add", line_id=F.lit("hand-2"), **hand),
        events(receipts, k % 9 == 0, 50, "set", "vendor", F.lit("Later")),
        events(receipts, k % 7 == 0, 60, "acknowledge"),
        events(receipts, k % 17 == 0, 61, "set", "colour", F.lit("red")),  # refused
    ]
    return rows, receipts, materialize(reduce(lambda a, b: a.unionByName(b), parts))


_EDITED = """base AS (SELECT l.*, CAST(pos AS VARCHAR) AS line_id, CAST(substr(source_file, 2, 8) AS INTEGER) AS k FROM receipt_lines l WHERE line_type = 'item'),
kept AS (SELECT *, k % 6 = 0 AS reset FROM base WHERE NOT (pos % 5 = 0 AND pos % 10 <> 0)),
final AS (SELECT trip_id, source_file, line_id, CASE WHEN pos % 7 = 0 THEN 'edited' ELSE trim(regexp_replace(description, '\\s+', ' ', 'g')) END AS description,
    CAST(CASE WHEN pos % 4 = 0 AND NOT reset THEN -5 ELSE amount END AS DECIMAL(18,2)) AS amount,
    CASE WHEN pos % 4 = 0 AND NOT reset THEN false WHEN pos % 3 = 0 AND NOT reset THEN NOT is_alcohol ELSE is_alcohol END AS is_alcohol,
    CASE WHEN pos % 11 = 0 THEN false ELSE in_sponsor END AS wanted, is_alcohol AS automatic, k % 5 = 0 AS reviewed, false AS manual FROM kept
  UNION ALL SELECT trip_id, source_file, 'hand-1', 'By hand', 3, true, true, true, CAST(substr(source_file, 2, 8) AS INTEGER) % 5 = 0, true FROM receipts
    WHERE CAST(substr(source_file, 2, 8) AS INTEGER) % 10 = 0 AND CAST(substr(source_file, 2, 8) AS INTEGER) % 6 <> 0
  UNION ALL SELECT trip_id, source_file, 'hand-2', 'By hand', 3, true, true, true, false, true FROM receipts WHERE CAST(substr(source_file, 2, 8) AS INTEGER) % 15 = 0)"""


@query(
    "rev10_edited_lines",
    oracle(
        "receipts receipt_lines",
        """SELECT trip_id, source_file, line_id, description, amount, is_alcohol, wanted AND NOT is_alcohol AS in_sponsor,
       CASE WHEN is_alcohol THEN 'alcohol' WHEN NOT wanted THEN 'other' END AS exclusion_reason, is_alcohol <> automatic AS alcohol_overridden, reviewed, manual FROM final""",
        _EDITED,
    ),
)
def _(spark, d):
    rows, receipts, log = _edit_log(spark, d)
    _, found, _ = edits.review_edits(receipts, rows, log)
    return found.select(*KEY, "line_id", "description", "amount", "is_alcohol", "in_sponsor", "exclusion_reason", "alcohol_overridden", "reviewed", "manual")


@query(
    "rev10_edited_receipts",
    oracle(
        "receipts receipt_lines",
        """SELECT r.trip_id, r.source_file, CASE WHEN k % 9 = 0 THEN 'Later' WHEN k % 8 = 0 AND k % 6 <> 0 THEN 'First' ELSE vendor END AS vendor,
       k % 5 = 0 AND k % 9 <> 0 AND k % 15 <> 0 AND NOT EXISTS (SELECT 1 FROM receipt_lines l WHERE l.trip_id = r.trip_id AND l.source_file = r.source_file AND line_type = 'item' AND pos % 10 = 0) AS reviewed,
       k % 7 = 0 AS acknowledged, (CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END + (SELECT count(*) FROM receipt_lines l WHERE l.trip_id = r.trip_id AND l.source_file = r.source_file AND line_type = 'item' AND pos % 13 = 0))::BIGINT AS refused
FROM (SELECT *, CAST(substr(source_file, 2, 8) AS INTEGER) AS k FROM receipts) r""",
    ),
)
def _(spark, d):
    rows, receipts, log = _edit_log(spark, d)
    found, _, refused = edits.review_edits(receipts, rows, log)
    counts = refused.groupBy(*KEY).agg(F.count("*").alias("refused"))
    return found.select(*KEY, "vendor", "reviewed", "acknowledged").join(counts, KEY, "left").na.fill(0, ["refused"])


@query(
    "rev11_scan_status",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'scanned' WHEN 1 THEN 'changed' ELSE 'not_scanned' END AS status FROM documents",
)
def _(spark, d):
    files = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("trip_id"), F.col("doc_id").cast("string").alias("source_file"), F.sha2("text", 256).alias("sha256")
    )
    stored = files.filter("doc_id % 3 < 2").select(
        *KEY, F.when(F.col("doc_id") % 3 == 0, F.col("sha256")).otherwise(F.lit("old")).alias("sha256")
    )
    return review.scan_status(files, stored).select("doc_id", "status")


@query(
    "rev12_metadata_rules",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'company' WHEN 1 THEN 'sponsored' WHEN 2 THEN '' ELSE 'club' END AS claim_program,
       concat_ws('|', CASE WHEN c_custkey % 5 = 0 THEN 'end before start' END, CASE WHEN c_custkey % 4 = 3 THEN 'program' END) AS errors,
       concat_ws('|', CASE WHEN c_custkey % 4 = 2 THEN 'reimbursement program' END, CASE WHEN c_custkey % 7 = 0 THEN 'traveller' END) AS gaps FROM customer""",
)
def _(spark, d):
    trips = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 4 == 0, F.lit("Company_Reimbursed")).when(F.col("c_custkey") % 4 == 1, F.lit("sponsored"))
        .when(F.col("c_custkey") % 4 == 2, F.lit(" ")).otherwise(F.lit("club")).alias("claim_program"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_name")).alias("traveller"),
        F.lit("").alias("default_paid_by"), F.lit("2026-01-05").cast("date").alias("start_date"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("2026-01-01")).otherwise(F.lit("2026-01-09")).cast("date").alias("end_date"),
    )
    return review.metadata_rules(trips).select(
        "c_custkey", "claim_program", F.array_join("errors", "|").alias("errors"), F.array_join("gaps", "|").alias("gaps")
    )


@query(
    "rev13_profile_rules",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'meal_deduction_pct must be between 0 and 1' ELSE '' END AS errors, CASE WHEN c_custkey % 2 = 0 THEN 'Trips' ELSE 'Travel – Non-meal' END AS non_meal FROM customer""",
)
def _(spark, d):
    base = table(spark, d, "customer")
    pct = lambda v: F.lit(v).cast("decimal(7,6)")
    profiles = base.select(
        "c_custkey",
        F.lit(None).cast("decimal(7,6)").alias("commercial_use_pct"), pct("1").alias("normal_tax_recovery_pct"), pct("0.5").alias("meal_tax_recovery_pct"),
        pct("1").alias("normal_deduction_pct"), F.when(F.col("c_custkey") % 3 == 0, pct("1.5")).otherwise(pct("0.5")).alias("meal_deduction_pct"),
        F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("non_meal"), F.lit("Trips"))).alias("account_mapping"),
    )
    return review.profile_rules(profiles).select(
        "c_custkey", F.array_join("errors", "|").alias("errors"), F.col("account_mapping")["non_meal"].alias("non_meal")
    )


@query(
    "rev14_reviewed_receipts",
    oracle(
        "receipts receipt_lines trips",
        "SELECT trip_id, source_file, CASE WHEN claim_program = 'sponsored' THEN in_sponsor AND in_company ELSE in_company END AS included, CASE WHEN claim_program = 'sponsored' THEN sponsor_included_total ELSE company_included_total END AS included_total FROM totals",
        LINES,
    ),
)
def _(spark, d):
    receipts = view(spark, d, "receipts").withColumn("review_note", F.lit(""))
    joined = receipts.join(view(spark, d, "trips").select("trip_id", "claim_program"), "trip_id")
    totals = lines.receipt_totals(tables.program_lines(spark, d), joined)
    return review.reviewed_receipts(receipts, totals).select(*KEY, "included", "included_total")


# ------------------------------------------------------------------ lineage and quality


def _inputs(spark, d):
    return view(spark, d, "receipts").select(
        "trip_id", F.lit("receipt").alias("kind"), F.col("source_file").alias("name"), F.sha2(F.coalesce(F.col("amount").cast("string"), F.lit("")), 256).alias("sha256")
    )


@query(
    "lng1_input_fingerprint",
    oracle(
        "receipts",
        """SELECT trip_id, CASE WHEN bool_or(expense_type = 'meal') THEN 'stale' ELSE 'current' END AS state FROM receipts GROUP BY 1""",
    ),
)
def _(spark, d):
    now = _inputs(spark, d)
    meals = view(spark, d, "receipts").select("trip_id", F.col("source_file").alias("name"), (F.col("expense_type") == "meal").alias("_m"))
    then = now.join(meals, ["trip_id", "name"]).withColumn("sha256", F.when(F.col("_m"), F.lit("old")).otherwise(F.col("sha256"))).drop("_m")
    return quality.freshness(quality.input_fingerprint(now), quality.input_fingerprint(then))


@query(
    "lng2_artifact_manifest",
    "SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' ELSE 'new' END AS drift FROM documents",
)
def _(spark, d):
    now = table(spark, d, "documents").select(
        F.col("lang").alias("trip_id"), F.col("doc_id").cast("string").alias("path"), "doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("sha256")
    )
    recorded = now.filter("doc_id % 3 < 2").withColumn("sha256", F.when(F.col("doc_id") % 3 == 0, F.col("sha256")).otherwise(F.lit("old")))
    return quality.artifact_drift(now, recorded).select("path", "drift")


@query(
    "lng3_lifecycle_status",
    oracle(
        "trips receipts",
        """SELECT t.trip_id, CASE WHEN t.trip_id LIKE '%9' THEN 'archived' WHEN t.trip_id LIKE '%8' THEN 'approved' WHEN coalesce(n, 0) = 0 THEN 'collecting' WHEN t.trip_id LIKE '%7' THEN 'ready_for_review' ELSE 'reconciling' END AS lifecycle
FROM trips t LEFT JOIN (SELECT trip_id, count(*) AS n FROM receipts GROUP BY 1) r ON r.trip_id = t.trip_id""",
    ),
)
def _(spark, d):
    counts = view(spark, d, "receipts").groupBy("trip_id").agg(F.count("*").alias("receipt_count"))
    trips = view(spark, d, "trips").join(counts, "trip_id", "left").withColumns(
        {
            "archived": F.col("trip_id").endswith("9"),
            "approval_current": F.col("trip_id").endswith("8"),
            "generation_current": F.col("trip_id").endswith("7"),
        }
    )
    return quality.lifecycle_status(trips).select("trip_id", "lifecycle")


@query(
    "lng4_trip_overview",
    oracle(
        "trips receipts statement_legs",
        """SELECT t.trip_id, coalesce(r, 0) AS receipt_count, coalesce(s, 0) AS statement_count FROM trips t LEFT JOIN (SELECT trip_id, count(*) AS r FROM receipts GROUP BY 1) a ON a.trip_id = t.trip_id
LEFT JOIN (SELECT trip_id, count(*) AS s FROM (SELECT DISTINCT trip_id, source_file FROM statement_legs) GROUP BY 1) b ON b.trip_id = t.trip_id WHERE t.claim_program = 'company'""",
    ),
)
def _(spark, d):
    r = view(spark, d, "receipts").select("trip_id", F.lit("receipt").alias("kind"), F.col("receipt_date").cast("timestamp").alias("modified_at"))
    s = view(spark, d, "statement_legs").select("trip_id", "source_file").distinct().select(
        "trip_id", F.lit("statement").alias("kind"), F.lit(None).cast("timestamp").alias("modified_at")
    )
    trips = view(spark, d, "trips").withColumn("archived", F.col("claim_program") == "sponsored")
    return quality.trip_overview(trips, r.unionByName(s)).select("trip_id", "receipt_count", "statement_count")


def _recorded(spark, d):
    """Inputs, and what was recorded when line review, reconciliation and bundle were made: not at all, before receipts or statements
    changed, or from an older line review."""
    t = F.substring("trip_id", 2, 6).cast("int")
    statement = view(spark, d, "statement_legs").groupBy("trip_id", "source_file").agg(F.sum("source_row").alias("n")).select(
        "trip_id", F.lit("statement").alias("kind"), F.col("source_file").alias("name"), F.sha2(F.col("n").cast("string"), 256).alias("sha256")
    )
    decision = view(spark, d, "dispositions").select("trip_id", F.lit("decision").alias("kind"), F.col("group_id").alias("name"), F.sha2("action", 256).alias("sha256"))
    now = materialize(_inputs(spark, d).unionByName(statement).unionByName(decision))
    old = ((F.col("kind") == "receipt") & (t % 4 == 1)) | ((F.col("kind") == "statement") & (t % 4 == 2))
    then = now.filter(t % 4 != 0).withColumn("sha256", F.when(old, F.lit("old")).otherwise(F.col("sha256")))
    made = materialize(quality.artifact_fingerprints(then))
    prints = made.groupBy("trip_id").agg(F.map_from_entries(F.collect_list(F.struct("artifact", "fingerprint"))).alias("m"))
    older = F.when(t % 8 == 3, F.lit("older")).otherwise(F.try_element_at("m", F.lit("line_review")))
    from_ = (
        F.when(F.col("artifact") == "reconciliation", F.create_map(F.lit("line_review"), older))
        .when(F.col("artifact") == "bundle", F.create_map(F.lit("line_review"), older, F.lit("reconciliation"), F.try_element_at("m", F.lit("reconciliation"))))
    )
    return now, made.join(prints, "trip_id").select("trip_id", "artifact", "fingerprint", from_.alias("made_from"))


@query(
    "lng1_derived_states",
    oracle(
        "receipts",
        """SELECT trip_id, artifact, CASE WHEN t % 4 = 0 THEN 'missing' WHEN t % 8 = 7 THEN 'current' WHEN artifact = 'line_review' AND t % 4 <> 1 THEN 'current' ELSE 'stale' END AS state
FROM (SELECT DISTINCT trip_id, CAST(substr(trip_id, 2) AS INTEGER) AS t FROM receipts), (VALUES ('line_review'), ('reconciliation'), ('bundle')) AS a(artifact)""",
    ),
)
def _(spark, d):
    return quality.derived_states(*_recorded(spark, d))


_HAVE = "t % 10 <> 5"


@query(
    "lng5_readiness_gates",
    claim_oracle(
        f"""SELECT trip_id, gate, CAST(n AS BIGINT) AS n FROM (
  SELECT trip_id, 'review_not_current' AS gate, 1 AS n FROM st WHERE t % 4 IN (0, 1)
  UNION ALL SELECT trip_id, 'reconciliation_missing', 1 FROM st WHERE t % 4 = 0 AND {_HAVE}
  UNION ALL SELECT trip_id, 'reconciliation_stale', 1 FROM st WHERE (t % 4 IN (1, 2) OR t % 8 = 3) AND {_HAVE}
  UNION ALL SELECT trip_id, 'line_totals', count(*) FROM totals WHERE expense_type = 'meal'
    AND (line_total - CASE WHEN claim_program = 'sponsored' THEN sponsor_included_total ELSE company_included_total END) > 0.005 AND NOT coalesce(line_total = amount, false) GROUP BY 1
  UNION ALL SELECT trip_id, 'blocking_exceptions', sum(n) FROM exceptions WHERE severity = 'blocking' GROUP BY 1 HAVING sum(n) > 0
  UNION ALL SELECT g.trip_id, 'split_open', count(*) FROM dec4 g JOIN st ON st.trip_id = g.trip_id WHERE allocation_status NOT IN ('none', 'balanced') AND {_HAVE} GROUP BY 1
  UNION ALL SELECT g.trip_id, 'needs_review', count_if(needs_review) FROM needs g JOIN st ON st.trip_id = g.trip_id WHERE {_HAVE} GROUP BY 1 HAVING count_if(needs_review) > 0
  UNION ALL SELECT g.trip_id, 'coverage_unconfirmed', count(*) FROM gaps g JOIN st ON st.trip_id = g.trip_id JOIN trips x ON x.trip_id = g.trip_id
    WHERE claim_program = 'company' AND {_HAVE} AND t % 6 <> 0 GROUP BY 1)""",
        POLICY_SQL + ",\n" + CATS + ",\nst AS (SELECT DISTINCT trip_id, CAST(substr(trip_id, 2) AS INTEGER) AS t FROM receipts)" + COV.removeprefix(DEC2.format(base="matched_groups")),
        "group_files",
    ),
)
def _(spark, d):
    """Statements in all trips but every tenth, gaps confirmed in every sixth."""
    t = F.substring("trip_id", 2, 6).cast("int")
    _, totals, exceptions = _exceptions(spark, d)
    decided = materialize(tables.decided_groups(spark, d))
    summary = claims.reconciliation_summary(materialize(tables.reconciled(spark, d, decided)), decided)
    gaps = materialize(coverage_gaps(spark, d))
    trips = view(spark, d, "trips")
    given = trips.filter(t % 6 == 0).select("trip_id", F.lit("1998-01-01").cast("timestamp").alias("confirmed_at"), F.lit("ok").alias("note"))
    then = gaps.join(given, "trip_id").select("trip_id", "confirmed_at", "code", "message")
    none = given.select("trip_id", F.col("confirmed_at").alias("updated_at")).limit(0)
    confirmations = coverage.coverage_confirmation(given, then, gaps, none)
    statements = view(spark, d, "statement_legs").select("trip_id").distinct().filter(t % 10 != 5)
    gates = quality.readiness_gates(quality.derived_states(*_recorded(spark, d)), statements, decided, totals, exceptions, summary, gaps, confirmations, trips)
    return gates.select("trip_id", "gate", "n")


QLT = """edited AS (SELECT trip_id, source_file, CASE WHEN expense_type = 'meal' THEN 'Other' ELSE vendor END AS vendor2, CASE WHEN expense_type = 'hotel' THEN NULL ELSE amount END AS amount2, * FROM receipts),
q AS (SELECT 'vendor' AS field, count(*) AS expected, count(*) AS present, count_if(vendor2 = vendor) AS correct FROM edited
  UNION ALL SELECT 'amount', count(amount), count_if(amount IS NOT NULL AND amount2 IS NOT NULL), count_if(amount IS NOT NULL AND amount2 = amount) FROM edited
  UNION ALL SELECT 'currency', count(*), count(*), count(*) FROM edited)"""


def _quality(spark, d, spoiled=True):
    truth = view(spark, d, "receipts").select(*KEY, "vendor", "amount", "currency", "expense_type")
    found = truth
    if spoiled:
        found = truth.withColumns(
            {
                "vendor": F.when(F.col("expense_type") == "meal", F.lit("Other")).otherwise(F.col("vendor")),
                "amount": F.when(F.col("expense_type") != "hotel", F.col("amount")),
            }
        )
    sums = view(spark, d, "receipt_lines").groupBy(*KEY).agg(F.sum("amount").alias("line_total"))
    problems = truth.select(F.lit("review").alias("severity"))
    return quality.extraction_quality(truth.drop("expense_type"), found.drop("expense_type"), sums, problems)


@query("qlt1_extraction_quality", oracle("receipts", "SELECT field, expected, present, correct FROM q UNION ALL SELECT NULL, CAST(sum(expected) AS BIGINT), CAST(sum(present) AS BIGINT), CAST(sum(correct) AS BIGINT) FROM q", QLT))
def _(spark, d):
    return _quality(spark, d).select("field", "expected", "present", "correct")


@query("qlt2_compare_quality", oracle("receipts", "SELECT field, CAST(expected - correct AS BIGINT) AS correct_delta FROM q UNION ALL SELECT NULL, CAST(sum(expected - correct) AS BIGINT) FROM q", QLT))
def _(spark, d):
    out = quality.compare_quality(_quality(spark, d), _quality(spark, d, spoiled=False))
    return out.select("field", "correct_delta")


DIFFER = ["vendor", "amount", "currency", "receipt_date", "expense_type"]
_DIFF = """other AS (SELECT trip_id, source_file, CASE WHEN expense_type = 'meal' THEN 'Other' ELSE vendor END AS vendor, CASE WHEN expense_type <> 'hotel' THEN amount END AS amount, currency, receipt_date, expense_type
    FROM receipts WHERE source_file NOT LIKE '%7.pdf'
  UNION ALL SELECT trip_id, concat('new-', source_file), vendor, amount, currency, receipt_date, expense_type FROM receipts WHERE source_file LIKE '%00.pdf'),
longer AS (SELECT 'b' AS run, trip_id, source_file, unnest([{'f': 'vendor', 'v': vendor}, {'f': 'amount', 'v': CAST(amount AS VARCHAR)}, {'f': 'currency', 'v': currency}, {'f': 'receipt_date', 'v': CAST(receipt_date AS VARCHAR)}, {'f': 'expense_type', 'v': expense_type}]) AS x FROM receipts
  UNION ALL SELECT 'o', trip_id, source_file, unnest([{'f': 'vendor', 'v': vendor}, {'f': 'amount', 'v': CAST(amount AS VARCHAR)}, {'f': 'currency', 'v': currency}, {'f': 'receipt_date', 'v': CAST(receipt_date AS VARCHAR)}, {'f': 'expense_type', 'v': expense_type}]) FROM other),
differing AS (SELECT coalesce(a.trip_id, b.trip_id) AS trip_id, coalesce(a.source_file, b.source_file) AS source_file, coalesce(a.x.f, b.x.f) AS field, a.x.v AS base_value, b.x.v AS other_value,
    CASE WHEN a.run IS NULL THEN 'other' WHEN b.run IS NULL THEN 'base' ELSE 'both' END AS side
  FROM (SELECT * FROM longer WHERE run = 'b') a FULL JOIN (SELECT * FROM longer WHERE run = 'o') b ON a.trip_id = b.trip_id AND a.source_file = b.source_file AND a.x.f = b.x.f
  WHERE a.x.v IS DISTINCT FROM b.x.v)"""


def _two_runs(spark, d):
    """The second run reads other vendors on meals, no amounts on hotels, misses some receipts and has some of its own."""
    base = view(spark, d, "receipts").select(*KEY, *DIFFER)
    other = base.filter("source_file not like '%7.pdf'").withColumns(
        {"vendor": F.when(F.col("expense_type") == "meal", F.lit("Other")).otherwise(F.col("vendor")), "amount": F.when(F.col("expense_type") != "hotel", F.col("amount"))}
    )
    own = base.filter("source_file like '%00.pdf'").withColumn("source_file", F.concat(F.lit("new-"), "source_file"))
    return quality.run_differences(base, other.unionByName(own), DIFFER)


@query("qlt2_run_differences", oracle("receipts", "SELECT * FROM differing", _DIFF))
def _(spark, d):
    return _two_runs(spark, d)


@query(
    "qlt2_field_differences",
    oracle("receipts", "SELECT f.field, count(d.field) AS receipts FROM (VALUES ('vendor'), ('amount'), ('currency'), ('receipt_date'), ('expense_type')) AS f(field) LEFT JOIN differing d ON d.field = f.field GROUP BY 1", _DIFF),
)
def _(spark, d):
    return quality.field_differences(_two_runs(spark, d), DIFFER)
