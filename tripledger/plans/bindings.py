"""Domain tables derived by SQL from the star-schema parquet tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its oracle start from
the same rows. ``{orders}`` and the like stand for the table in the respective engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TRIP = "concat('T', lpad(CAST({0} AS VARCHAR(10)), 6, '0'))"
FILE = "concat('r', lpad(CAST({0} AS VARCHAR(10)), 8, '0'), '.pdf')"
GROUP = "concat('g', lpad(CAST({0} AS VARCHAR(10)), 8, '0'))"
WORD = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'abcd' WHEN 1 THEN 'efgh' WHEN 2 THEN 'ijkl' "
    "WHEN 3 THEN 'mnop' WHEN 4 THEN 'qrst' ELSE 'uvwx' END"
)
CURRENCY = "CASE o_custkey % 4 WHEN 0 THEN 'CAD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'QAR' END"

VIEWS: dict[str, str] = {
    "trips": f"""
SELECT {TRIP.format("c_custkey")} AS trip_id, c_name AS traveller,
       CASE WHEN c_custkey % 2 = 0 THEN 'company' ELSE 'sponsored' END AS claim_program,
       DATE '1995-01-01' AS start_date, DATE '2001-08-01' AS end_date,
       CAST(200 + c_custkey % 100 AS DECIMAL(18,2)) AS meal_limit
FROM {{customer}}""",
    "receipts": f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {FILE.format("o_orderkey")} AS source_file,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS receipt_date,
       {WORD} AS vendor,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'flight' WHEN '2-HIGH' THEN 'hotel' WHEN '3-MEDIUM' THEN 'transport'
            WHEN '5-LOW' THEN 'meal' ELSE 'other' END AS expense_type,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE
            CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,2)) END AS amount,
       {CURRENCY} AS currency,
       CAST(1 + o_orderkey % 3 AS INT) AS number_of_people,
       CASE WHEN o_orderkey % 7 = 0 THEN 'company_card' WHEN o_orderkey % 11 = 0 THEN 'sponsor' ELSE 'traveller_personal' END AS paid_by,
       CASE WHEN o_orderkey % 23 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0015 AS DECIMAL(5,4)) AS DECIMAL(18,2)) END AS manual_cad,
       CASE WHEN o_orderkey % 19 = 0 THEN false ELSE true END AS in_company,
       CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 13 = 0 THEN false ELSE true END AS in_sponsor,
       CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0.60 ELSE 0.90 END AS DOUBLE) AS confidence,
       CASE WHEN o_orderkey % 21 = 0 THEN '' ELSE concat('trip to ', o_orderpriority) END AS description,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0009 AS DECIMAL(5,4)) AS DECIMAL(18,2)) AS subtotal,
       CASE WHEN o_orderkey % 8 < 5 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.00005 AS DECIMAL(6,5)) AS DECIMAL(18,2)) END AS gst_hst,
       CASE WHEN o_orderkey % 8 < 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.00009 AS DECIMAL(6,5)) AS DECIMAL(18,2)) END AS qst,
       CASE WHEN o_orderkey % 3 = 0 THEN '123456789RT0001' ELSE '' END AS gst_hst_number,
       CASE WHEN o_orderkey % 4 = 0 THEN '1234567890TQ0001' ELSE '' END AS qst_number,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Acme' ELSE '' END AS purchaser_name,
       CASE WHEN o_orderkey % 3 = 1 THEN 'net 30' ELSE '' END AS payment_terms,
       CASE WHEN o_custkey % 4 = 0 THEN 'Canada' WHEN o_custkey % 4 = 1 THEN 'United States' ELSE '' END AS country,
       CASE o_orderkey % 4 WHEN 0 THEN 'QC' WHEN 1 THEN 'ON' WHEN 2 THEN 'BC' ELSE '' END AS province,
       CASE WHEN o_orderkey % 26 = 0 THEN 'non_business' END AS exclusion_reason
FROM {{orders}}""",
    "fx_observations": """
SELECT c.currency, d.obs_date,
       CAST(c.base_rate + (day(d.obs_date) % 7) * CAST(0.0100 AS DECIMAL(6,4)) AS DECIMAL(20,10)) AS cad_per_unit
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS obs_date, 1 AS k FROM {orders}) d
JOIN (SELECT 'USD' AS currency, CAST(1.3500 AS DECIMAL(6,4)) AS base_rate, 1 AS k
      UNION ALL SELECT 'EUR', CAST(1.4700 AS DECIMAL(6,4)), 1) c ON c.k = d.k""",
    "statement_legs": f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {GROUP.format("o_orderkey")} AS group_id,
       concat({GROUP.format("o_orderkey")}, ':', CAST(leg AS VARCHAR(10))) AS leg_id,
       concat('s', CAST(o_orderkey % 5 AS VARCHAR(10)), '.csv') AS source_file,
       CAST(o_orderkey * 10 + leg AS BIGINT) AS source_row,
       CASE o_orderkey % 3 WHEN 0 THEN 'amex' WHEN 1 THEN 'bmo' ELSE 'wise' END AS provider,
       concat('card-', CAST(o_orderkey % 4 AS VARCHAR(10))) AS account_label,
       CAST(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5) AS DATE) AS transaction_date,
       {WORD} AS description,
       CASE WHEN o_orderstatus = 'P' THEN 'payment' WHEN o_orderkey % 17 = 0 THEN 'refund' ELSE 'purchase' END AS transaction_type,
       o_orderstatus <> 'P' AS match_eligible,
       CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) *
            CASE o_orderkey % 12 WHEN 0 THEN CAST(0.001 AS DECIMAL(8,7)) WHEN 3 THEN CAST(0.0012 AS DECIMAL(8,7))
                 WHEN 6 THEN CAST(0.001 AS DECIMAL(8,7)) WHEN 9 THEN CAST(0.002 AS DECIMAL(8,7))
                 ELSE CASE o_orderkey % 3 WHEN 1 THEN CAST(0.0005 AS DECIMAL(8,7)) ELSE CAST(0.0001666 AS DECIMAL(8,7)) END END
            AS DECIMAL(18,2)) AS purchase_amount,
       {CURRENCY} AS purchase_currency,
       CASE WHEN o_orderkey % 4 < 2 THEN CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END *
            CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0014 AS DECIMAL(8,7)) AS DECIMAL(18,2)) END AS settlement_amount,
       CASE WHEN o_orderkey % 4 < 2 THEN 'CAD' END AS settlement_currency,
       CASE WHEN o_orderkey % 4 < 2 THEN CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END *
            CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0014 AS DECIMAL(8,7)) AS DECIMAL(18,2))
            WHEN o_custkey % 4 = 0 THEN CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END *
            CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0010 AS DECIMAL(8,7)) AS DECIMAL(18,2)) END AS cad_amount,
       CASE WHEN o_orderkey % 31 = 0 THEN 'review' ELSE 'ok' END AS normalization_status,
       '' AS review_note
FROM (SELECT *, 1 AS leg FROM {{orders}}
      UNION ALL SELECT *, 2 AS leg FROM {{orders}} WHERE o_orderkey % 3 = 2) o""",
    "receipt_lines": f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {FILE.format("l_orderkey")} AS source_file,
       CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos,
       CASE l_partkey % 7 WHEN 0 THEN 'Shiraz' WHEN 1 THEN 'Ginger beer' WHEN 2 THEN 'GST' WHEN 3 THEN 'Espresso martini'
            WHEN 4 THEN 'Mocktail' ELSE p_name END AS description,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,2)) AS amount,
       CASE WHEN l_partkey % 7 = 2 THEN 'tax' ELSE 'item' END AS line_type,
       CASE WHEN l_partkey % 7 IN (0, 3) THEN true ELSE false END AS is_alcohol,
       CAST(CASE WHEN l_partkey % 11 = 0 THEN 0.60 ELSE 0.95 END AS DOUBLE) AS confidence,
       l_partkey % 9 <> 0 AS in_sponsor, CASE WHEN l_partkey % 18 = 0 THEN 'policy_cap' END AS exclusion_reason
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _PLACEHOLDER.findall(VIEWS[name]):
            if dep in VIEWS:
                visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _render(text: str, table: str) -> str:
    return _PLACEHOLDER.sub(
        lambda m: m.group(1) if m.group(1) in VIEWS else table.format(m.group(1)), text
    )


def ctes(*names: str, table: str = "{}") -> str:
    """``a AS (...), b AS (...)`` for the views and everything they build on."""
    return ",\n".join(f"{n} AS ({_render(VIEWS[n], table)})" for n in _closure(list(names)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = "parquet.`" + sf_dir.rstrip("/") + "/{}.parquet`"
    return spark.sql(f"WITH {ctes(name, table=table)} SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def oracle(names: str, body: str, extra: str = "") -> str:
    """Oracle text: WITH the named views (and optional further CTEs) then the body."""
    head = ctes(*names.split())
    return f"WITH {head}{', ' + extra if extra else ''}\n{body}"

LEG_COLUMNS = (
    "trip_id group_id leg_id source_file source_row provider account_label transaction_date description "
    "transaction_type match_eligible purchase_amount purchase_currency settlement_amount settlement_currency "
    "cad_amount normalization_status review_note"
).split()
# Overlapping exports: every seventh row is exported again in a second file.
VIEWS["statement_exports"] = (
    f"SELECT {', '.join(LEG_COLUMNS)} FROM {{statement_legs}} UNION ALL SELECT "
    + ", ".join("'s9.csv' AS source_file" if c == "source_file" else c for c in LEG_COLUMNS)
    + " FROM {statement_legs} WHERE source_row % 7 = 0"
)

# Groups with an automatic match already chosen by key, for the operators after matching.
_CAD = (
    "CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) "
    "* CAST(0.0014 AS DECIMAL(8,7)) AS DECIMAL(18,2))"
)
VIEWS["matched_groups"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id,
       concat(CASE WHEN part = 1 THEN 'g' ELSE 'h' END, lpad(CAST(o_orderkey AS VARCHAR(10)), 8, '0')) AS group_id,
       CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5) AS DATE) END AS transaction_date,
       CASE o_orderkey % 3 WHEN 0 THEN 'amex' WHEN 1 THEN 'bmo' ELSE 'wise' END AS provider,
       concat('card-', CAST(o_orderkey % 4 AS VARCHAR(10))) AS account_label, {WORD} AS description,
       CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) *
            CASE o_orderkey % 12 WHEN 3 THEN CAST(0.0012 AS DECIMAL(8,7)) WHEN 9 THEN CAST(0.002 AS DECIMAL(8,7))
                 WHEN 1 THEN CAST(0.0005 AS DECIMAL(8,7)) WHEN 5 THEN CAST(0.0003333 AS DECIMAL(8,7))
                 ELSE CAST(0.001 AS DECIMAL(8,7)) END AS DECIMAL(18,2)) AS purchase_amount,
       CASE WHEN o_orderkey % 53 = 0 THEN 'GBP' ELSE {CURRENCY} END AS purchase_currency,
       CASE WHEN o_orderkey % 6 <> 4 THEN {_CAD} END AS cad_amount,
       CASE WHEN o_orderstatus = 'P' THEN 'not_applicable' WHEN o_orderkey % 6 <> 4 THEN 'complete' ELSE 'incomplete' END AS cad_completeness,
       o_orderstatus <> 'P' AS match_eligible,
       CASE WHEN o_orderkey % 31 = 0 THEN 'review' WHEN o_orderkey % 41 = 0 THEN 'possible_duplicate' ELSE 'ok' END AS normalization_status,
       CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 < 3 THEN {FILE.format("o_orderkey")} END AS matched_file,
       CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 < 4 THEN {FILE.format("o_orderkey")} END AS suggested_file,
       CASE WHEN o_orderstatus = 'P' THEN 'audit' WHEN o_orderkey % 5 < 3 THEN 'auto' WHEN o_orderkey % 5 = 3 THEN 'suggested' ELSE 'unmatched' END AS match_status,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 0.000 WHEN o_orderkey % 5 < 3 THEN 0.900 WHEN o_orderkey % 5 = 3 THEN 0.750 ELSE 0.000 END AS DECIMAL(6,3)) AS match_confidence,
       CASE WHEN o_orderkey % 10 = 3 THEN 'Receipt is 20% below the card total; review tax or tip.' ELSE '' END AS review_reason
FROM (SELECT *, 1 AS part FROM {{orders}} UNION ALL SELECT *, 2 AS part FROM {{orders}} WHERE o_orderkey % 10 = 1) o"""
VIEWS["group_files"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {GROUP.format("o_orderkey")} AS group_id,
       concat('s', CAST(o_orderkey % 5 AS VARCHAR(10)), '.csv') AS source_file, CAST(o_orderkey AS BIGINT) AS source_row
FROM {{orders}}"""
VIEWS["manual_matches"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {GROUP.format("o_orderkey")} AS group_id,
       CASE WHEN o_orderkey % 58 = 0 THEN NULL WHEN o_orderkey % 87 = 0 THEN 'gone.pdf' ELSE {FILE.format("o_orderkey")} END AS source_file
FROM {{orders}} WHERE o_orderkey % 29 = 0"""
VIEWS["dispositions"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {GROUP.format("o_orderkey")} AS group_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'keep' ELSE 'unresolved' END AS action, 'seen' AS note,
       o_orderdate AS updated_at
FROM {{orders}} WHERE o_orderkey % 37 = 0 OR o_orderkey % 41 = 0"""
VIEWS["allocations"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {GROUP.format("o_orderkey")} AS group_id,
       concat('A00', CAST(n AS VARCHAR(3))) AS allocation_id,
       CASE WHEN n = 1 AND o_orderkey % 17 = 0 THEN 'refund' WHEN n = 1 THEN 'purchase' WHEN o_orderkey % 430 = 0 THEN 'gift' ELSE 'personal' END AS type,
       CASE WHEN n = 1 AND o_orderkey % 129 = 0 THEN 'gone.pdf' WHEN n = 1 THEN {FILE.format("o_orderkey")} END AS source_file,
       '' AS category,
       CASE WHEN n = 1 AND o_orderkey % 86 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0007 AS DECIMAL(8,7)) AS DECIMAL(18,2)) END AS original_amount,
       CASE WHEN n = 1 THEN CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0010 AS DECIMAL(8,7)) AS DECIMAL(18,2))
            WHEN o_orderkey % 172 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0009 AS DECIMAL(8,7)) AS DECIMAL(18,2))
            ELSE {_CAD} - CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0010 AS DECIMAL(8,7)) AS DECIMAL(18,2)) END AS cad_amount,
       CASE WHEN o_orderkey % 5 = 0 AND n = 2 THEN '' ELSE 'why' END AS note
FROM (SELECT *, 1 AS n FROM {{orders}} UNION ALL SELECT *, 2 AS n FROM {{orders}}) o WHERE o_orderkey % 43 = 0"""
VIEWS["basis"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {FILE.format("o_orderkey")} AS source_file,
       CASE WHEN o_orderkey % 2 = 0 THEN 'full_receipt' ELSE 'personal_share' END AS basis, o_orderdate AS updated_at
FROM {{orders}} WHERE o_orderkey % 47 = 0"""
VIEWS["field_edits"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, {FILE.format("o_orderkey")} AS source_file, 'vendor' AS field, 'Edited' AS value, o_orderdate AS updated_at
FROM {{orders}} WHERE o_orderkey % 9 = 0
UNION ALL
SELECT {TRIP.format("o_custkey")}, {FILE.format("o_orderkey")}, 'amount', CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '12.50' END, o_orderdate
FROM {{orders}} WHERE o_orderkey % 16 < 2"""

# Receipt texts with known content; the extraction has to recover it.
_M3 = (
    "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * (month(o_orderdate) - 1) + 1 AS INT), 3)"
)
_Y = "CAST(year(o_orderdate) + 20 AS VARCHAR(4))"
_MM = "lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0')"
_DD = "lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0')"
_ISO = f"concat({_Y}, '-', {_MM}, '-', {_DD})"
_PART = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST({0} AS DECIMAL(8,6)) AS DECIMAL(18,2))"
_VENDOR = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'Blue Kitchen' WHEN 1 THEN 'City Taxi' WHEN 2 THEN 'Grand Hotel' ELSE 'Paper Shop' END"
)
_KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'meal' WHEN 1 THEN 'transport' WHEN 2 THEN 'hotel' ELSE 'other' END"
VIEWS["receipt_text"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id,
       CASE WHEN o_orderkey % 15 = 5 THEN concat('scan_', {_Y}, {_MM}, {_DD}, '_', lpad(CAST(o_orderkey AS VARCHAR(10)), 8, '0'), '.pdf')
            ELSE {FILE.format("o_orderkey")} END AS source_file,
       concat_ws(chr(10), {_VENDOR},
         CASE o_orderkey % 3 WHEN 0 THEN concat('Invoice date: ', {_ISO}) WHEN 1 THEN concat('Served ', CAST(day(o_orderdate) AS VARCHAR(2)), ' ', {_M3}, ' ', {_Y}) END,
         concat('Shiraz glass ', CAST({_PART.format("0.0003")} AS VARCHAR(20))),
         concat('Garlic bread ', CAST({_PART.format("0.0002")} AS VARCHAR(20))),
         CASE WHEN o_orderkey % 6 = 0 THEN concat('Bread basket', chr(10), CAST({_PART.format("0.0001")} AS VARCHAR(20))) END,
         concat('Subtotal ', CAST({_PART.format("0.0009")} AS VARCHAR(20))),
         concat('GST ', CAST({_PART.format("0.00005")} AS VARCHAR(20))),
         concat('QST ', CAST({_PART.format("0.00009")} AS VARCHAR(20))),
         CASE WHEN o_orderkey % 2 = 0 THEN 'GST no 123456789 RT0001' END,
         CASE WHEN o_orderkey % 3 = 0 THEN 'QST no 1234567890 TQ0001' END,
         CASE WHEN o_orderkey % 11 = 0 THEN concat('TOTAL $', CAST({_PART.format("0.001")} AS VARCHAR(20)))
              ELSE concat('TOTAL ', {CURRENCY}, ' ', CAST({_PART.format("0.001")} AS VARCHAR(20))) END,
         CASE o_orderkey % 4 WHEN 0 THEN 'Montreal' WHEN 1 THEN 'Toronto' END) AS raw_text,
       'text' AS method, {_VENDOR} AS exp_vendor, {_KIND} AS exp_type,
       CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 15 <> 5 THEN NULL ELSE CAST({_ISO} AS DATE) END AS exp_date,
       o_orderkey % 15 = 5 AS exp_from_name, {_PART.format("0.001")} AS exp_amount,
       CASE WHEN o_orderkey % 11 = 0 THEN 'AUD' ELSE {CURRENCY} END AS exp_currency,
       {_PART.format("0.0009")} AS exp_subtotal, {_PART.format("0.00005")} AS exp_gst, {_PART.format("0.00009")} AS exp_qst,
       {_PART.format("0.0003")} AS a1, {_PART.format("0.0002")} AS a2, {_PART.format("0.0001")} AS a3,
       CASE WHEN o_orderkey % 2 = 0 THEN '123456789RT0001' ELSE '' END AS exp_gst_number,
       CASE WHEN o_orderkey % 3 = 0 THEN '1234567890TQ0001' ELSE '' END AS exp_qst_number,
       CASE o_orderkey % 4 WHEN 0 THEN 'QC' WHEN 1 THEN 'ON' ELSE '' END AS exp_province, o_orderkey AS k
FROM {{orders}}"""
VIEWS["raw_cells"] = f"""
SELECT o_orderkey AS k, {_PART.format("0.001")} AS num, CAST({_ISO} AS DATE) AS day_value,
       CASE o_orderkey % 7 WHEN 0 THEN CAST({_PART.format("0.001")} AS VARCHAR(20)) WHEN 1 THEN concat('(', CAST({_PART.format("0.001")} AS VARCHAR(20)), ')')
            WHEN 2 THEN concat('$ ', CAST({_PART.format("0.001")} AS VARCHAR(20)), ' CR') WHEN 3 THEN replace(CAST({_PART.format("0.001")} AS VARCHAR(20)), '.', ',')
            WHEN 4 THEN concat('1.', lpad(replace(CAST({_PART.format("0.001")} AS VARCHAR(20)), '.', ','), 6, '0'))
            WHEN 5 THEN concat('1,', lpad(CAST({_PART.format("0.001")} AS VARCHAR(20)), 6, '0')) ELSE 'n/a' END AS num_text,
       CASE o_orderkey % 6 WHEN 0 THEN {_ISO} WHEN 1 THEN concat({_DD}, '-', {_M3}, '-', substr({_Y}, 3, 2)) WHEN 2 THEN concat({_DD}, ' ', {_M3}, ' ', {_Y})
            WHEN 3 THEN concat({_DD}, '/', {_MM}, '/', {_Y}) WHEN 4 THEN concat({_Y}, {_MM}, {_DD}) ELSE concat({_ISO}, ' 10:11:12') END AS date_text,
       concat('  ', o_orderpriority, '   x ') AS words, concat('US$ ', {CURRENCY}) AS cur_text,
       concat(CAST({_PART.format("0.001")} AS VARCHAR(20)), ' ', CASE o_orderkey % 2 WHEN 0 THEN 'US DOLLAR' ELSE 'EURO' END) AS foreign_text,
       concat('xx', lpad(CAST(o_orderkey AS VARCHAR(10)), 10, '0')) AS account_text,
       CASE o_orderkey % 4 WHEN 0 THEN 'SQ*BLUE  CAFE SYDNEY NSW' WHEN 1 THEN 'NIGEL BAR' WHEN 2 THEN 'paper shop - LONDON GB' ELSE 'Plain Name' END AS merchant_text
FROM {{orders}}"""

# Statement exports as text lines: one file per trip, one layout per trip (p = 0..6).
_HEADERS = {
    0: (1, "Date,Date Processed,Description,Card Member,Account,Amount"),
    1: (3, "First Bank Card,Transaction Type,Date Posted,Transaction Amount,Description"),
    2: (1, "Date;Card Number;Description;Category;Debit;Credit"),
    3: (
        1,
        "ID,Status,Direction,Created on,Finished on,Source amount after fees,Source fee amount,Source currency,"
        "Target amount after fees,Target currency,Source name,Target name,Category",
    ),
    4: (
        1,
        "transaction_date,description,purchase_amount,purchase_currency,cad_amount,transaction_type,posted_date,account,"
        "cardholder,category",
    ),
    5: (1, "transaction_date,posted_date,transaction_type,description,settlement_amount,settlement_currency"),
    6: (1, "Purchase date|Shop details|Amount|Currency"),
}
_A = "CAST(amt AS VARCHAR(20))"
_NA = "CAST(CASE WHEN back OR pay THEN -amt ELSE amt END AS VARCHAR(20))"
_ROW = {
    0: f"concat_ws(',', dmon, dmon, words, 'Jo', 'xx1234', {_NA})",
    1: f"concat_ws(',', 'x9876', CASE WHEN back OR pay THEN 'CREDIT' ELSE 'DEBIT' END, packed, {_A}, words)",
    2: f"""concat('"', concat_ws(';', iso, 'xx5555', words, 'Food', CASE WHEN back OR pay THEN '' ELSE {_A} END, CASE WHEN back OR pay THEN {_A} ELSE '' END), '"')""",
    3: f"concat_ws(',', concat('CARD_TRANSACTION-', CAST(k AS VARCHAR(10))), CASE WHEN back THEN 'REFUNDED' ELSE 'COMPLETED' END, 'OUT', "
    f"concat(iso, ' 08:00:00'), '', {_A}, '0.50', 'CAD', CAST(half AS VARCHAR(20)), 'EUR', 'Jo', words, 'Food')",
    4: f"concat_ws(',', iso, words, {_NA}, cur, '', CASE WHEN pay THEN 'payment' ELSE '' END, '', 'Visa 1', 'Jo', 'Food')",
    5: f"concat_ws(',', iso, iso, CASE WHEN pay THEN 'payment' WHEN back THEN 'refund' ELSE 'purchase' END, words, {_A}, cur)",
    6: f"concat_ws('|', dmy, words, {_NA}, cur)",
}
VIEWS["statement_base"] = f"""
SELECT {TRIP.format("o_custkey")} AS trip_id, 'card.csv' AS source_file, o_custkey % 7 AS p, o_orderkey AS k,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, {_PART.format("0.001")} AS amt, {_PART.format("0.0005")} AS half,
       o_orderkey % 17 = 0 AS back, o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0 AS pay, {CURRENCY} AS cur, CAST({_ISO} AS DATE) AS day_value,
       CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0 THEN 'payment thanks' ELSE {WORD} END AS words,
       {_ISO} AS iso, concat({_DD}, '-', {_M3}, '-', substr({_Y}, 3, 2)) AS dmon, concat({_Y}, {_MM}, {_DD}) AS packed, concat({_DD}, '/', {_MM}, '/', {_Y}) AS dmy
FROM {{orders}}"""
_TAB = "replace({0}, '|', chr(9))"
VIEWS["statement_lines"] = (
    "SELECT trip_id, source_file, CAST(rn + CASE WHEN p = 1 THEN 3 ELSE 1 END AS BIGINT) AS row_no, CASE p "
    + " ".join(f"WHEN {i} THEN {_ROW[i] if i < 6 else _TAB.format(_ROW[i])}" for i in _ROW)
    + " END AS line FROM {statement_base} UNION ALL SELECT DISTINCT trip_id, source_file, CAST(CASE WHEN p = 1 THEN 3 ELSE 1 END AS BIGINT), CASE p "
    + " ".join(f"WHEN {i} THEN {repr(h) if i < 6 else _TAB.format(repr(h))}" for i, (_, h) in _HEADERS.items())
    + " END FROM {statement_base} UNION ALL SELECT DISTINCT trip_id, source_file, CAST(1 AS BIGINT), 'Statement export' FROM {statement_base} WHERE p = 1"
)
