"""Plain-SQL (DuckDB) statements of intermediate tables, used inside oracle texts only."""

FX = """
fx_direct AS (
  SELECT currency, CAST(date_trunc('week', obs_date) AS DATE) AS week_start,
         CAST(CAST(date_trunc('week', obs_date) AS DATE) + 6 AS DATE) AS week_end,
         CAST(avg(CAST(cad_per_unit AS DOUBLE)) AS DECIMAL(20,10)) AS cad_per_unit,
         'weekly_average_direct' AS method, concat(currency, '→CAD') AS route, count(*) AS observation_count
  FROM fx_observations GROUP BY 1, 2, 3),
fx_rates AS (
  SELECT * FROM fx_direct WHERE currency <> 'QAR'
  UNION ALL
  SELECT 'QAR', week_start, week_end, CAST(CAST(cad_per_unit AS DOUBLE) / 3.64 AS DECIMAL(20,10)),
         'weekly_average_official_peg', 'QAR→USD→CAD', observation_count
  FROM fx_direct WHERE currency = 'USD')"""

AUDIT = """
legs_audit AS (
  SELECT *, cad_amount IS NOT NULL AND match_eligible AS exact,
         CASE WHEN cad_amount IS NOT NULL AND match_eligible AND coalesce(purchase_amount, 0) <> 0
              THEN CAST(CAST(abs(cad_amount) AS DOUBLE) / CAST(abs(purchase_amount) AS DOUBLE) AS DECIMAL(20,10))
              WHEN cad_amount IS NOT NULL AND match_eligible AND settlement_currency = 'CAD' THEN CAST(1 AS DECIMAL(20,10)) END AS cad_rate,
         CASE WHEN cad_amount IS NOT NULL AND match_eligible AND coalesce(purchase_amount, 0) <> 0
              THEN concat(purchase_currency, '→CAD')
              WHEN cad_amount IS NOT NULL AND match_eligible AND settlement_currency = 'CAD' THEN 'CAD→CAD' ELSE '' END AS cad_route,
         CASE WHEN cad_amount IS NULL OR NOT match_eligible THEN ''
              WHEN purchase_currency = 'CAD' THEN 'statement_purchase_cad'
              WHEN settlement_currency = 'CAD' THEN 'statement_exact_cad_settlement' ELSE '' END AS cad_method
  FROM statement_legs),
legs_cad AS (
  SELECT a.* EXCLUDE (cad_amount, cad_rate, cad_route, cad_method, exact),
         CASE WHEN hit THEN CAST(purchase_amount * rate AS DECIMAL(18,2)) ELSE cad_amount END AS cad_amount,
         CASE WHEN hit THEN rate ELSE cad_rate END AS cad_rate,
         CASE WHEN hit THEN fx_route ELSE cad_route END AS cad_route,
         CASE WHEN hit THEN fx_method ELSE cad_method END AS cad_method,
         CASE WHEN hit THEN CAST(date_trunc('week', transaction_date) AS DATE) END AS cad_week_start
  FROM (SELECT l.*, r.cad_per_unit AS rate, r.route AS fx_route, r.method AS fx_method,
               r.cad_per_unit IS NOT NULL AND l.match_eligible AND l.cad_amount IS NULL AND l.purchase_amount IS NOT NULL AS hit
        FROM legs_audit l LEFT JOIN fx_rates r
          ON r.currency = l.purchase_currency AND r.week_start = CAST(date_trunc('week', l.transaction_date) AS DATE)) a),
group_state AS (
  SELECT trip_id, group_id,
         CASE WHEN count_if(match_eligible) = 0 THEN 'not_applicable'
              WHEN count_if(match_eligible AND cad_amount IS NULL) = 0 THEN 'complete'
              WHEN count_if(match_eligible AND cad_amount IS NOT NULL) > 0 THEN 'partial'
              ELSE 'incomplete' END AS cad_completeness
  FROM legs_cad GROUP BY 1, 2),
groups_raw AS (
  SELECT l.trip_id, l.group_id, any_value(s.cad_completeness) AS cad_completeness,
         arg_min({'d': transaction_date, 'p': provider, 'a': account_label, 's': description, 't': transaction_type},
                 concat(CASE WHEN match_eligible THEN '0' ELSE '1' END, source_file, lpad(CAST(source_row AS VARCHAR), 12, '0'))) AS rep,
         CASE WHEN count(DISTINCT purchase_currency) FILTER (match_eligible) = 1
              THEN any_value(purchase_currency) FILTER (match_eligible) END AS purchase_currency,
         CASE WHEN count_if(match_eligible) > 0 AND count_if(match_eligible AND purchase_amount IS NULL) = 0
              THEN sum(purchase_amount) FILTER (match_eligible) END AS purchase_sum,
         sum(cad_amount) FILTER (match_eligible) AS cad_sum,
         min(cad_rate) FILTER (match_eligible) AS rate_low, max(cad_rate) FILTER (match_eligible) AS rate_high,
         coalesce(CASE count(DISTINCT nullif(cad_method, '')) FILTER (match_eligible) WHEN 0 THEN '' WHEN 1 THEN
              any_value(nullif(cad_method, '')) FILTER (match_eligible) ELSE 'mixed' END, '') AS cad_method,
         bool_or(match_eligible) AS match_eligible,
         CASE WHEN bool_or(normalization_status = 'possible_duplicate') THEN 'possible_duplicate'
              WHEN bool_or(normalization_status = 'review') THEN 'review' ELSE min(normalization_status) END AS normalization_status,
         bool_and(NOT match_eligible OR normalization_status IN ('ok', 'duplicate_confirmed')) AS clean_legs,
         count(*) AS leg_count
  FROM legs_cad l JOIN group_state s ON s.trip_id = l.trip_id AND s.group_id = l.group_id GROUP BY 1, 2),
txn_groups AS (
  SELECT trip_id, group_id, rep.d AS transaction_date, rep.p AS provider, rep.a AS account_label, rep.s AS description,
         rep.t AS transaction_type, CAST(CASE WHEN purchase_currency IS NOT NULL THEN purchase_sum END AS DECIMAL(18,2)) AS purchase_amount,
         purchase_currency, CAST(CASE WHEN cad_completeness = 'complete' THEN cad_sum END AS DECIMAL(18,2)) AS cad_amount,
         cad_completeness, rate_low, rate_high, cad_method, match_eligible, normalization_status, clean_legs, leg_count
  FROM groups_raw)"""


MATCH = """
receipts_s AS (
  SELECT *, CAST(round(CAST(abs(amount) AS DOUBLE) / greatest(1, coalesce(number_of_people, 1)), 6) AS DECIMAL(18,6)) AS share
  FROM receipts),
cards AS (
  SELECT *, abs(purchase_amount) AS p_abs, abs(cad_amount) AS c_abs FROM txn_groups WHERE match_eligible),
estimates AS (
  SELECT r.trip_id, r.source_file, r.currency, r.share, x.rate AS fx_rate, CAST(CAST(r.share * x.rate AS DECIMAL(30,16)) AS DECIMAL(18,2)) AS estimated_cad
  FROM receipts_s r
  JOIN (SELECT currency, week_start, cad_per_unit AS rate FROM fx_rates
        UNION ALL SELECT DISTINCT 'CAD', CAST(date_trunc('week', receipt_date) AS DATE), CAST(1 AS DECIMAL(20,10)) FROM receipts WHERE receipt_date IS NOT NULL) x
    ON x.currency = r.currency AND x.week_start = CAST(date_trunc('week', r.receipt_date) AS DATE)
  WHERE r.share IS NOT NULL AND r.receipt_date IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM cards g WHERE g.trip_id = r.trip_id AND g.purchase_currency = r.currency
                    AND abs(r.share - g.p_abs) <= greatest(0.03, r.share * 0.015))
    AND EXISTS (SELECT 1 FROM cards g WHERE g.trip_id = r.trip_id AND g.cad_amount IS NOT NULL
                AND abs(date_diff('day', g.transaction_date, r.receipt_date)) <= 7)),
pairs AS (
  SELECT r.trip_id, r.source_file, g.group_id, r.receipt_date, g.transaction_date, r.share, r.currency, g.purchase_currency,
         g.p_abs, g.c_abs, e.estimated_cad, r.vendor, g.description, g.clean_legs, g.cad_amount, g.purchase_amount,
         abs(date_diff('day', r.receipt_date, g.transaction_date)) AS delta,
         coalesce(r.currency = g.purchase_currency AND abs(r.share - g.p_abs) <= greatest(0.03, r.share * 0.015), false)
           OR coalesce(r.currency = 'CAD' AND abs(r.share - g.c_abs) <= greatest(0.03, r.share * 0.015), false) AS same_amount,
         coalesce(abs(e.estimated_cad - g.c_abs) <= greatest(0.50, e.estimated_cad * 0.06), false) AS fx_amount,
         coalesce(abs(r.share - g.c_abs) <= greatest(0.03, r.share * 0.015), false) AS number_amount,
         CASE WHEN r.currency = g.purchase_currency THEN g.p_abs WHEN r.currency = 'CAD' THEN g.c_abs END AS card_amount,
         CASE WHEN lower(r.vendor) = lower(g.description) THEN 1 ELSE 0 END AS same_text
  FROM receipts_s r JOIN cards g ON g.trip_id = r.trip_id
  LEFT JOIN estimates e ON e.trip_id = r.trip_id AND e.source_file = r.source_file),
pairs2 AS (
  SELECT *, coalesce(share > 0 AND card_amount > share AND share >= card_amount * 0.68 AND share <= card_amount * 0.95, false) AS has_gap
  FROM pairs),
scored AS (
  SELECT *, CAST(least(1,
      CASE WHEN delta = 0 THEN 0.30 WHEN delta <= 3 THEN greatest(0.00, 0.24 - 0.05 * delta) ELSE 0.00 END
    + CASE WHEN share IS NULL THEN 0.00 WHEN same_amount THEN 0.36 WHEN fx_amount THEN 0.46 WHEN number_amount THEN 0.18 WHEN has_gap THEN 0.22 ELSE 0.00 END
    + CASE WHEN delta = 0 AND share IS NOT NULL AND (same_amount OR fx_amount OR number_amount) THEN 0.08 ELSE 0.00 END
    + 0.46 * same_text) AS DECIMAL(6,3)) AS score,
    CASE WHEN has_gap THEN CAST(round_even((1.0 - CAST(share AS DOUBLE) / CAST(card_amount AS DOUBLE)) * 100, 0) AS INTEGER) END AS gap_percent,
    CAST(least(1,
      CASE WHEN delta = 0 THEN 0.35 WHEN delta <= 5 THEN greatest(0.05, 0.28 - 0.05 * delta) ELSE 0.00 END
    + CASE WHEN share IS NULL THEN 0.00 WHEN same_amount OR fx_amount THEN 0.55 WHEN has_gap THEN 0.25 ELSE 0.00 END
    + CASE WHEN delta = 0 AND share IS NOT NULL AND (same_amount OR fx_amount) THEN 0.05 ELSE 0.00 END
    + 0.35 * same_text) AS DECIMAL(6,3)) AS score3
  FROM pairs2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trip_id, group_id ORDER BY score DESC, lower(source_file)) AS rn FROM scored),
best AS (SELECT * FROM ranked WHERE rn = 1 AND score >= 0.35),
reasons AS (
  SELECT *, CASE WHEN gap_percent IS NULL THEN ''
      WHEN delta = 0 AND same_text = 1 THEN concat('Same merchant and date; receipt is ', CAST(gap_percent AS VARCHAR), '% below the card total, possibly tax or tip.')
      ELSE concat('Receipt is ', CAST(gap_percent AS VARCHAR), '% below the card total; review tax or tip.') END AS review_reason
  FROM best),
assigned AS (
  SELECT trip_id, group_id, CASE WHEN score >= 0.72 AND review_reason = '' AND clean_legs THEN source_file END AS matched_file,
         source_file AS suggested_file,
         CASE WHEN score >= 0.72 AND review_reason = '' AND clean_legs THEN 'auto' ELSE 'suggested' END AS match_status,
         score AS match_confidence, review_reason
  FROM reasons),
matched AS (
  SELECT g.*, a.matched_file, a.suggested_file,
         coalesce(a.match_status, CASE WHEN match_eligible THEN 'unmatched' ELSE 'audit' END) AS match_status,
         coalesce(a.match_confidence, CAST(0 AS DECIMAL(6,3))) AS match_confidence, coalesce(a.review_reason, '') AS review_reason
  FROM txn_groups g LEFT JOIN assigned a ON a.trip_id = g.trip_id AND a.group_id = g.group_id)"""


def half_up(num: str, den: str) -> str:
    """SQL: integer num / den rounded half away from zero."""
    return f"(sign({num}) * ((2 * abs({num}) + ({den})) // (2 * ({den}))))"


def cents(expr: str) -> str:
    return f"CAST(({expr}) * 100 AS HUGEINT)"


def money(int_expr: str) -> str:
    return f"CAST(CAST({int_expr} AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


LINES = f"""
lines_prog AS (
  SELECT * EXCLUDE (in_sponsor, exclusion_reason), true AS in_company, NOT is_alcohol AND in_sponsor AS in_sponsor,
         CASE WHEN is_alcohol THEN 'alcohol' WHEN in_sponsor THEN NULL ELSE coalesce(exclusion_reason, 'other') END AS exclusion_reason
  FROM receipt_lines),
line_sums AS (
  SELECT trip_id, source_file, sum(amount) AS line_total, sum(amount) AS company_included_total,
         coalesce(sum(amount) FILTER (in_sponsor), 0) AS sponsor_included_total FROM lines_prog GROUP BY 1, 2),
totals AS (
  SELECT r.*, CAST(coalesce(line_total, 0) AS DECIMAL(18,2)) AS line_total, CAST(coalesce(company_included_total, 0) AS DECIMAL(18,2)) AS company_included_total,
         CAST(coalesce(sponsor_included_total, 0) AS DECIMAL(18,2)) AS sponsor_included_total, t.claim_program
  FROM receipts r JOIN trips t ON t.trip_id = r.trip_id LEFT JOIN line_sums s ON s.trip_id = r.trip_id AND s.source_file = r.source_file)"""

CAD = """
contributions AS (
  SELECT trip_id, matched_file AS source_file, CASE WHEN cad_completeness = 'complete' THEN cad_amount END AS cad,
         CASE WHEN cad_completeness = 'complete' AND purchase_amount <> 0 THEN abs(purchase_amount) END AS purchase,
         CASE WHEN cad_completeness = 'complete' AND purchase_amount <> 0 THEN purchase_currency END AS currency,
         NOT (cad_completeness = 'complete' AND cad_amount IS NOT NULL) AS incomplete, false AS allocated
  FROM dec4 WHERE allocation_status = 'none' AND NOT ignored AND matched_file IS NOT NULL
  UNION ALL
  SELECT a.trip_id, a.source_file, a.cad_amount, abs(coalesce(a.original_amount, CASE WHEN a.parts = 1 THEN g.purchase_amount END)),
         CASE WHEN coalesce(a.original_amount, CASE WHEN a.parts = 1 THEN g.purchase_amount END) IS NOT NULL THEN g.purchase_currency END, false, true
  FROM (SELECT al.*, count(*) OVER (PARTITION BY al.trip_id, al.group_id) AS parts FROM allocations al
        JOIN receipts r ON r.trip_id = al.trip_id AND r.source_file = al.source_file WHERE al.type IN ('purchase', 'refund', 'fee')) a
  JOIN dec4 g ON g.trip_id = a.trip_id AND g.group_id = a.group_id AND g.allocation_status = 'balanced'),
cad_totals AS (
  SELECT trip_id, source_file, CAST(coalesce(sum(cad), 0) AS DECIMAL(18,2)) AS cad_total,
         CASE WHEN min(currency) = max(currency) THEN CAST(sum(purchase) AS DECIMAL(18,6)) END AS statement_purchase_amount,
         CASE WHEN min(currency) = max(currency) THEN min(currency) END AS statement_purchase_currency,
         bool_or(incomplete) AS incomplete, bool_or(allocated) AS allocated, count(*) AS group_count
  FROM contributions GROUP BY 1, 2),
sourced AS (
  SELECT r.*, c.cad_total, c.statement_purchase_amount, c.statement_purchase_currency, coalesce(c.group_count, 0) AS group_count,
         CASE WHEN b.basis = 'full_receipt' OR r.number_of_people > 1 THEN b.basis END AS explicit_basis,
         CASE WHEN manual_cad IS NOT NULL THEN manual_cad WHEN group_count IS NOT NULL AND NOT incomplete THEN cad_total
              WHEN r.currency = 'CAD' AND group_count IS NULL THEN amount END AS cad_amount_used,
         CASE WHEN manual_cad IS NOT NULL THEN 'manual'
              WHEN group_count IS NOT NULL AND NOT incomplete THEN concat(CASE WHEN allocated THEN 'allocation' ELSE 'statement' END, CASE WHEN group_count > 1 THEN '_aggregated' ELSE '' END)
              WHEN r.currency = 'CAD' AND group_count IS NULL THEN 'invoice' ELSE 'unavailable' END AS cad_source
  FROM totals r LEFT JOIN cad_totals c ON c.trip_id = r.trip_id AND c.source_file = r.source_file
  LEFT JOIN basis b ON b.trip_id = r.trip_id AND b.source_file = r.source_file),
based0 AS (
  SELECT *, cad_source LIKE 'statement%' OR cad_source LIKE 'allocation%' AS from_statement, abs(amount) AS ra, abs(statement_purchase_amount) AS ca,
         CAST(round(CAST(abs(amount) AS DOUBLE) / number_of_people, 6) AS DECIMAL(18,6)) AS sh FROM sourced),
based1 AS (
  SELECT *, CASE WHEN coalesce(amount, 0) = 0 THEN 'unavailable'
       WHEN NOT from_statement OR coalesce(ca, 0) = 0 THEN 'receipt_total'
       WHEN currency <> coalesce(statement_purchase_currency, '') THEN 'receipt_fallback_currency'
       WHEN group_count > 1 THEN 'statement_aggregated'
       WHEN abs(ca - ra) <= greatest(2, ra * 0.08) THEN 'statement_receipt_total'
       WHEN ca > ra + greatest(2, ra * 0.08) AND ca <= ra * 1.35 THEN 'statement_includes_tip'
       WHEN number_of_people > 1 AND abs(ca - sh) <= greatest(2, sh * 0.08) THEN 'statement_person_share'
       WHEN number_of_people > 1 AND ca > sh + greatest(2, sh * 0.08) AND ca <= sh * 1.35 THEN 'statement_person_share_includes_tip'
       ELSE 'receipt_fallback_mismatch' END AS st FROM based0),
based2 AS (
  SELECT *, explicit_basis IS NOT NULL AND from_statement AND coalesce(amount, 0) <> 0 AS expl FROM based1),
based AS (
  SELECT *, CASE WHEN expl THEN concat('statement_', explicit_basis, '_explicit') ELSE st END AS st2,
         CASE WHEN expl THEN CASE WHEN explicit_basis = 'personal_share' THEN sh ELSE ra END
              WHEN st = 'unavailable' THEN NULL WHEN st LIKE 'statement%' THEN ca ELSE ra END AS fx_basis_amount
  FROM based2),
reconciled AS (
  SELECT *, CASE WHEN cad_source = 'manual' THEN concat('manual_', st2) ELSE st2 END AS fx_basis_status,
         coalesce(explicit_basis, CASE WHEN st2 IN ('statement_person_share', 'statement_person_share_includes_tip', 'statement_personal_share_explicit') THEN 'personal_share' ELSE 'full_receipt' END) AS statement_amount_basis,
         CASE WHEN cad_amount_used IS NOT NULL AND coalesce(fx_basis_amount, 0) <> 0
              THEN CAST(CAST(abs(cad_amount_used) AS DOUBLE) / CAST(fx_basis_amount AS DOUBLE) AS DECIMAL(18,6)) END AS fx_rate,
         CASE WHEN st2 <> 'statement_aggregated' AND coalesce(amount, 0) <> 0 AND statement_purchase_amount IS NOT NULL AND currency = statement_purchase_currency
              THEN CAST(ca - CASE WHEN st2 IN ('statement_person_share', 'statement_person_share_includes_tip') OR (st2 = 'receipt_fallback_mismatch' AND number_of_people > 1) THEN sh ELSE ra END AS DECIMAL(18,2)) END AS statement_receipt_difference
  FROM based)"""

_CUT_C = "(line_total - company_included_total) > 0.005 AND line_total <> 0"
_CUT_S = "(line_total - sponsor_included_total) > 0.005 AND line_total <> 0"


def _program(included: str, line_in: str, cut: str) -> str:
    num = f"CASE WHEN {cut} THEN {cents(line_in)} ELSE 1 END"
    den = f"CASE WHEN {cut} THEN {cents('line_total')} ELSE 1 END"
    original = half_up(cents(f"CASE WHEN {cut} THEN {line_in} ELSE coalesce(amount, 0) END"), "number_of_people")
    full = half_up(f"({cents('cad2')} * {num})", f"({den}) * number_of_people")
    share = half_up(f"({cents('cad2')} * {num})", den)
    return f"""CASE WHEN NOT {included} THEN CAST(0 AS DECIMAL(18,2))
      WHEN manual_cad IS NOT NULL THEN {money(full)}
      WHEN cad2 IS NOT NULL AND from_statement THEN CASE WHEN statement_amount_basis = 'personal_share' THEN {money(share)} ELSE {money(full)} END
      ELSE CAST({money(original)} * fx_rate AS DECIMAL(18,2)) END"""


CLAIM = f"""
claim0 AS (SELECT *, coalesce(cad_amount_used, CASE WHEN currency = 'CAD' THEN amount END) AS cad2,
                  CASE WHEN cad_amount_used IS NULL AND currency = 'CAD' THEN 'invoice' ELSE cad_source END AS source2, in_sponsor AND in_company AS in_sp FROM reconciled),
claim1 AS (SELECT *, {_program("in_company", "company_included_total", _CUT_C)} AS total_cad,
                  {_program("in_sp", "sponsor_included_total", _CUT_S)} AS sp_cad,
                  CASE WHEN in_company THEN CAST(1.0 / number_of_people AS DECIMAL(10,8)) ELSE CAST(0 AS DECIMAL(10,8)) END AS company_ratio FROM claim0),
claim2 AS (SELECT *, CAST(CASE WHEN claim_program = 'sponsored' THEN least(coalesce(total_cad, 0), coalesce(sp_cad, 0)) ELSE 0 END AS DECIMAL(18,2)) AS sponsor_claim_cad FROM claim1),
expenses AS (
  SELECT * EXCLUDE (cad_amount_used, cad_source), cad2 AS cad_amount_used, source2 AS cad_source,
         CAST(CASE WHEN claim_program = 'sponsored' THEN coalesce(total_cad, 0) - sponsor_claim_cad ELSE 0 END AS DECIMAL(18,2)) AS sponsor_excluded_cad,
         CASE WHEN paid_by = 'traveller_personal' THEN total_cad ELSE CAST(0 AS DECIMAL(18,2)) END AS reimbursable_cad,
         CASE WHEN paid_by = 'company_card' THEN total_cad ELSE CAST(0 AS DECIMAL(18,2)) END AS corporate_paid_cad,
         greatest(0, coalesce(cad2, 0) - coalesce(total_cad, 0)) AS company_excluded_cad,
         CASE WHEN NOT in_company THEN 'excluded' WHEN cad2 IS NOT NULL THEN 'ready' ELSE 'review' END AS claim_status
  FROM claim2),
summary AS (
  SELECT trip_id, count(*) AS expense_count, count_if(in_company) AS included_count, count_if(NOT in_company) AS excluded_count,
         count_if(cad_source LIKE 'statement%' OR cad_source LIKE 'allocation%') AS matched_count,
         CAST(coalesce(sum(total_cad), 0) AS DECIMAL(18,2)) AS reviewed_total_cad, CAST(coalesce(sum(reimbursable_cad), 0) AS DECIMAL(18,2)) AS reimbursement_total_cad,
         CAST(coalesce(sum(corporate_paid_cad), 0) AS DECIMAL(18,2)) AS corporate_paid_total_cad, CAST(coalesce(sum(sponsor_claim_cad), 0) AS DECIMAL(18,2)) AS sponsor_claim_total_cad,
         CAST(coalesce(sum(sponsor_excluded_cad), 0) AS DECIMAL(18,2)) AS sponsor_excluded_total_cad, CAST(coalesce(sum(company_excluded_cad), 0) AS DECIMAL(18,2)) AS excluded_or_personal_cad
  FROM expenses GROUP BY 1),
taxed0 AS (
  SELECT *, CASE WHEN expense_type LIKE 'meal%' THEN CAST(0.5 AS DECIMAL(7,6)) ELSE CAST(1 AS DECIMAL(7,6)) END AS recovery,
         coalesce(nullif(fx_rate, 0), CASE WHEN currency = 'CAD' THEN CAST(1 AS DECIMAL(18,6)) ELSE CAST(0 AS DECIMAL(18,6)) END) AS fx
  FROM expenses WHERE reimbursable_cad IS NOT NULL AND in_company),
taxed1 AS (
  SELECT *, CAST(CAST(CAST(coalesce(gst_hst, 0) AS DECIMAL(10,2)) * CAST(fx AS DECIMAL(12,6)) * company_ratio AS DECIMAL(18,2)) * recovery AS DECIMAL(20,8)) AS recoverable_gst,
         CAST(CAST(CAST(coalesce(qst, 0) AS DECIMAL(10,2)) * CAST(fx AS DECIMAL(12,6)) * company_ratio AS DECIMAL(18,2)) * recovery AS DECIMAL(20,8)) AS recoverable_qst,
         CAST(least(reimbursable_cad, sponsor_claim_cad) AS DECIMAL(20,8)) AS passed FROM taxed0),
taxed AS (
  SELECT *, CAST(reimbursable_cad - recoverable_gst - recoverable_qst AS DECIMAL(20,8)) AS net_cad,
         CASE WHEN claim_program = 'sponsored' THEN CAST(reimbursable_cad - passed AS DECIMAL(20,8)) ELSE CAST(reimbursable_cad - recoverable_gst - recoverable_qst AS DECIMAL(20,8)) END AS base FROM taxed1),
postings AS (
  SELECT trip_id, 'expenses_recoverable_from_clients' AS account_key, passed AS part FROM taxed WHERE claim_program = 'sponsored'
  UNION ALL SELECT trip_id, 'meal_deductible', CAST(base * CAST(0.5 AS DECIMAL(7,6)) AS DECIMAL(20,8)) FROM taxed WHERE expense_type LIKE 'meal%'
  UNION ALL SELECT trip_id, 'meal_nondeductible', CAST(base - CAST(base * CAST(0.5 AS DECIMAL(7,6)) AS DECIMAL(20,8)) AS DECIMAL(20,8)) FROM taxed WHERE expense_type LIKE 'meal%'
  UNION ALL SELECT trip_id, 'non_meal', base FROM taxed WHERE expense_type NOT LIKE 'meal%'
  UNION ALL SELECT trip_id, 'gst_hst_receivable', recoverable_gst FROM taxed WHERE claim_program <> 'sponsored'
  UNION ALL SELECT trip_id, 'qst_receivable', recoverable_qst FROM taxed WHERE claim_program <> 'sponsored'),
posted AS (
  SELECT trip_id, account_key, CAST(sum(part) AS DECIMAL(18,2)) AS amount_cad FROM postings GROUP BY 1, 2 HAVING abs(sum(part)) >= 0.005),
journal0 AS (
  SELECT p.*, s.reimbursement_total_cad - sum(amount_cad) OVER (PARTITION BY p.trip_id) AS residual,
         row_number() OVER (PARTITION BY p.trip_id ORDER BY CASE account_key WHEN 'meal_nondeductible' THEN 0 WHEN 'non_meal' THEN 1 WHEN 'meal_deductible' THEN 2 ELSE 99 END,
            CASE account_key WHEN 'expenses_recoverable_from_clients' THEN 'Expenses' WHEN 'gst_hst_receivable' THEN 'GST' ELSE 'QST' END) AS rn
  FROM posted p JOIN summary s ON s.trip_id = p.trip_id),
journal AS (
  SELECT trip_id, account_key, CAST(CASE WHEN rn = 1 AND abs(residual) BETWEEN 0.005 AND 0.05 THEN residual ELSE 0 END AS DECIMAL(18,2)) AS rounding_adjustment_cad,
         CAST(amount_cad + CASE WHEN rn = 1 AND abs(residual) BETWEEN 0.005 AND 0.05 THEN residual ELSE 0 END AS DECIMAL(18,2)) AS amount_cad FROM journal0),
control AS (
  SELECT s.trip_id, CAST(reviewed_total_cad - reimbursement_total_cad - corporate_paid_total_cad AS DECIMAL(18,2)) AS payer_difference_cad,
         CAST(CASE WHEN claim_program = 'sponsored' THEN reviewed_total_cad - sponsor_claim_total_cad - sponsor_excluded_total_cad ELSE 0 END AS DECIMAL(18,2)) AS sponsor_difference_cad,
         CAST(coalesce((SELECT sum(amount_cad) FROM journal j WHERE j.trip_id = s.trip_id), 0) - reimbursement_total_cad AS DECIMAL(18,2)) AS accounting_difference_cad
  FROM summary s JOIN trips t ON t.trip_id = s.trip_id)"""
