"""Queries of receipt text extraction. The bound texts have known content the operators recover."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripledger.functions import cleaners
from tripledger.functions.materialize import spread
from tripledger.operators import alcohol, lines, receipt_text
from tripledger.plans.bindings import oracle, table, view
from tripledger.plans.registry import query

KEY = ["trip_id", "source_file"]
AUD_NOTE = "Currency inferred as AUD from $; review if receipt is not Australian."


def text_oracle(body: str) -> str:
    return oracle("receipt_text", body)


def _extracted(spark, d):
    return receipt_text.extract_receipts(spread(view(spark, d, "receipt_text").select(*KEY, "raw_text", "method")))


@query(
    "txt1_text_lines",
    text_oracle(
        """SELECT trip_id, source_file, CAST(len(string_split(raw_text, chr(10))) AS INTEGER) AS line_count,
       string_split(raw_text, chr(10))[1] AS first_line, string_split(raw_text, chr(10))[-1] AS last_line FROM receipt_text"""
    ),
)
def _(spark, d):
    out = receipt_text.with_lines(view(spark, d, "receipt_text"))
    return out.select(
        *KEY, F.size("lines").alias("line_count"), F.get("lines", F.lit(0)).alias("first_line"),
        F.element_at("lines", -1).alias("last_line"),
    )


@query(
    "txt2_money_tokens",
    text_oracle(
        """SELECT trip_id, source_file, CAST(6 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS token_count,
       CAST(a1 + a2 + CASE WHEN k % 6 = 0 THEN a3 ELSE 0 END + exp_subtotal + exp_gst + exp_qst + exp_amount AS DECIMAL(18,2)) AS token_sum FROM receipt_text"""
    ),
)
def _(spark, d):
    money = F.flatten(F.transform("info", lambda x: x["money"]))
    total = F.aggregate(money, F.lit(0).cast("decimal(18,2)"), lambda acc, m: (acc + m["amount"]).cast("decimal(18,2)"))
    return receipt_text.with_lines(view(spark, d, "receipt_text")).select(
        *KEY, F.size(money).alias("token_count"), total.alias("token_sum")
    )


@query("txt2_money_tokens_documents")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text")))
    money = F.flatten(F.transform("info", lambda x: x["money"]))
    return receipt_text.with_lines(docs).select("doc_id", F.size(money).alias("token_count"))


@query("txt3_find_date", text_oracle("SELECT trip_id, source_file, exp_date AS receipt_date FROM receipt_text"))
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "receipt_date")


@query(
    "txt4_date_fallback_note",
    text_oracle(
        f"""SELECT trip_id, source_file, concat_ws(' ', CASE WHEN exp_from_name THEN concat('Date ', CAST(exp_date AS VARCHAR), ' inferred from the source filename because no date was found in the receipt content; review.') END,
       CASE WHEN k % 11 = 0 THEN '{AUD_NOTE}' END) AS review_note FROM receipt_text"""
    ),
)
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "review_note")


@query("txt5_find_supplier", text_oracle("SELECT trip_id, source_file, exp_vendor AS vendor FROM receipt_text"))
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "vendor")


@query("txt6_find_total", text_oracle("SELECT trip_id, source_file, exp_amount AS amount FROM receipt_text"))
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "amount")


@query("txt7_infer_currency", text_oracle("SELECT trip_id, source_file, exp_currency AS currency FROM receipt_text"))
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "currency")


@query(
    "txt8_line_items",
    text_oracle(
        """SELECT trip_id, source_file, description, amount FROM (
  SELECT trip_id, source_file, 'Shiraz glass' AS description, a1 AS amount, k FROM receipt_text UNION ALL
  SELECT trip_id, source_file, 'Garlic bread', a2, k FROM receipt_text UNION ALL
  SELECT trip_id, source_file, 'QST', exp_qst, k FROM receipt_text UNION ALL
  SELECT trip_id, source_file, 'Bread basket', a3, k FROM receipt_text WHERE k % 6 = 0) WHERE k % 4 = 0"""
    ),
)
def _(spark, d):
    return receipt_text.purchase_lines(_extracted(spark, d)).select(*KEY, "description", "amount")


@query("txt9_classify_expense", text_oracle("SELECT trip_id, source_file, exp_type AS expense_type FROM receipt_text"))
def _(spark, d):
    return _extracted(spark, d).select(*KEY, receipt_text.simple_type(F.col("expense_type")).alias("expense_type"))


@query(
    "txt10_extract_tax",
    text_oracle("SELECT trip_id, source_file, exp_gst AS gst_hst, exp_qst AS qst, exp_subtotal AS subtotal FROM receipt_text"),
)
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "gst_hst", "qst", "subtotal")


@query(
    "txt11_tax_registration",
    text_oracle("SELECT trip_id, source_file, exp_gst_number AS gst_hst_number, exp_qst_number AS qst_number FROM receipt_text"),
)
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "gst_hst_number", "qst_number")


@query(
    "txt12_infer_location",
    text_oracle(
        """SELECT trip_id, source_file, exp_province AS province, CASE WHEN exp_province <> '' OR exp_currency = 'CAD' THEN 'Canada'
       WHEN exp_currency = 'USD' THEN 'United States' WHEN exp_currency = 'AUD' THEN 'Australia' WHEN exp_currency = 'QAR' THEN 'Qatar' ELSE '' END AS country FROM receipt_text"""
    ),
)
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "province", "country")


@query(
    "txt13_confidence_score",
    text_oracle(
        """SELECT trip_id, source_file, CAST(least(CASE WHEN k % 11 = 0 THEN 0.68 ELSE 1 END, CASE WHEN exp_from_name THEN 0.70 ELSE 1 END,
       0.15 + CASE WHEN exp_date IS NOT NULL THEN 0.25 ELSE 0 END + 0.20 + 0.25 + CASE WHEN length(raw_text) > 300 THEN 0.10 ELSE 0 END) AS DECIMAL(4,2)) AS confidence FROM receipt_text"""
    ),
)
def _(spark, d):
    return _extracted(spark, d).select(*KEY, "confidence")


@query(
    "txt14_quality_score",
    oracle(
        "receipts receipt_lines trips",
        """SELECT trip_id, source_file, CASE WHEN q1 >= q2 THEN 1 ELSE 2 END AS version, greatest(q1, q2) AS quality FROM (
  SELECT r.trip_id, r.source_file, CAST(CASE WHEN receipt_date IS NOT NULL THEN 2 ELSE 0 END + 2 + CASE WHEN amount IS NOT NULL THEN 2 ELSE 0 END + 1
         + CASE WHEN expense_type <> 'meal' THEN 0 WHEN amount IS NULL OR t IS NULL THEN 0 WHEN abs(t - amount) > greatest(0.05, amount * 0.03) THEN 0.75 ELSE 2 END
         + CAST(confidence AS DECIMAL(4,2)) AS DECIMAL(6,2)) AS q1,
         CAST(CASE WHEN receipt_date IS NOT NULL THEN 2 ELSE 0 END + 2 + 2 + 1
         + CASE WHEN expense_type <> 'meal' THEN 0 WHEN amount IS NULL OR t IS NULL THEN 0 WHEN abs(t - amount) > greatest(0.05, amount * 0.03) THEN 0.75 ELSE 2 END + 0.30 AS DECIMAL(6,2)) AS q2
  FROM receipts r LEFT JOIN (SELECT trip_id, source_file, sum(amount) AS t FROM receipt_lines GROUP BY 1, 2) s ON s.trip_id = r.trip_id AND s.source_file = r.source_file)""",
    ),
)
def _(spark, d):
    receipts = view(spark, d, "receipts")
    notes = lines.reconcile_note(view(spark, d, "receipt_lines"), receipts)
    scored = receipts.join(notes, KEY).withColumn("version", F.lit(1))
    second = scored.withColumns(
        {
            "version": F.lit(2),
            "amount": F.coalesce("amount", F.lit(1).cast("decimal(18,2)")),
            "confidence": F.lit(0.30).cast("double"),
        }
    )
    versions = scored.unionByName(second).withColumn("quality", receipt_text.quality_score(F.col("note")))
    return receipt_text.best_extraction(versions).select(*KEY, "version", "quality")


@query(
    "txt15_alcohol_detect",
    oracle(
        "receipt_lines",
        """SELECT trip_id, source_file, pos, description IN ('Shiraz', 'Espresso martini') AS is_alcohol,
       CASE description WHEN 'Shiraz' THEN 'shiraz' WHEN 'Espresso martini' THEN 'espresso martini' WHEN 'Ginger beer' THEN 'ginger beer' WHEN 'Mocktail' THEN 'mocktail' WHEN 'GST' THEN 'gst' ELSE '' END AS alcohol_matched_term,
       CAST(CASE description WHEN 'Shiraz' THEN 0.93 WHEN 'Espresso martini' THEN 0.97 WHEN 'Ginger beer' THEN 0.99 WHEN 'Mocktail' THEN 0.99 WHEN 'GST' THEN 0.99 ELSE 0.80 END AS DECIMAL(3,2)) AS alcohol_confidence
FROM receipt_lines""",
    ),
)
def _(spark, d):
    return alcohol.detect_alcohol(spread(view(spark, d, "receipt_lines"))).select(
        *KEY, "pos", "is_alcohol", "alcohol_matched_term", "alcohol_confidence"
    )


@query(
    "txt16_parse_number",
    oracle(
        "raw_cells",
        """SELECT k, CASE k % 7 WHEN 1 THEN -num WHEN 2 THEN -num WHEN 4 THEN num + 1000 WHEN 5 THEN num + 1000 WHEN 6 THEN NULL ELSE num END AS number FROM raw_cells""",
    ),
)
def _(spark, d):
    cells = view(spark, d, "raw_cells")
    return cells.select("k", cleaners.parse_number(F.col("num_text")).cast("decimal(18,2)").alias("number"))


@query("txt16_parse_date", oracle("raw_cells", "SELECT k, day_value FROM raw_cells"))
def _(spark, d):
    cells = view(spark, d, "raw_cells")
    return cells.select("k", cleaners.parse_date(F.col("date_text"), F.lit("day_first")).alias("day_value"))


@query(
    "txt16_scalar_cleaners",
    oracle(
        "raw_cells",
        """SELECT k, concat(trim(regexp_replace(words, '\\s+', ' ', 'g'))) AS cleaned, regexp_extract(upper(cur_text), '\\b([A-Z]{3})\\b', 1) AS code,
       num AS foreign_amount, CASE WHEN k % 2 = 0 THEN 'USD' ELSE 'EUR' END AS foreign_currency, concat('••••', right(account_text, 4)) AS account,
       left(sha1(concat_ws('|', words, account_text)), 12) AS row_hash FROM raw_cells""",
    ),
)
def _(spark, d):
    foreign = cleaners.foreign_value(F.col("foreign_text"))
    return view(spark, d, "raw_cells").select(
        "k",
        cleaners.clean_text(F.col("words")).alias("cleaned"),
        cleaners.currency_code(F.col("cur_text")).alias("code"),
        foreign["amount"].cast("decimal(18,2)").alias("foreign_amount"),
        foreign["currency"].alias("foreign_currency"),
        cleaners.mask_account(F.col("account_text")).alias("account"),
        cleaners.stable_hash(F.col("words"), F.col("account_text")).alias("row_hash"),
    )


@query(
    "txt17_merchant_clean",
    oracle(
        "raw_cells",
        "SELECT k, CASE k % 4 WHEN 0 THEN 'Blue Cafe' WHEN 1 THEN 'Nigel' WHEN 2 THEN 'Paper Shop' ELSE 'Plain Name' END AS merchant FROM raw_cells",
    ),
)
def _(spark, d):
    return view(spark, d, "raw_cells").select("k", cleaners.merchant_clean(F.col("merchant_text")).alias("merchant"))


@query(
    "txt19_merge_external_extraction",
    oracle(
        "receipts receipt_lines trips",
        """SELECT l.trip_id, l.source_file, pos, 'local' AS origin, description IN ('Shiraz', 'Espresso martini') AS is_alcohol
FROM receipt_lines l JOIN choice c ON c.trip_id = l.trip_id AND c.source_file = l.source_file WHERE use_local
UNION ALL
SELECT l.trip_id, l.source_file, pos, 'external', description IN ('Shiraz', 'Espresso martini') OR (pos % 2 = 0 AND description NOT IN ('Ginger beer', 'Mocktail', 'GST'))
FROM ext l JOIN choice c ON c.trip_id = l.trip_id AND c.source_file = l.source_file WHERE NOT use_local""",
        """ext AS (SELECT trip_id, source_file, pos, CASE WHEN pos % 10 = 4 THEN '' ELSE description END AS description, amount
  FROM receipt_lines WHERE trip_id < 'T000700' AND pos % 5 <> 3),
ls AS (SELECT trip_id, source_file, sum(CASE WHEN description <> 'GST' THEN amount ELSE 0 END) AS s, count_if(description <> 'GST') AS n FROM receipt_lines GROUP BY 1, 2),
es AS (SELECT trip_id, source_file, sum(CASE WHEN description <> 'GST' THEN amount ELSE 0 END) AS s, count_if(description <> 'GST') AS n FROM ext GROUP BY 1, 2),
totals AS (SELECT r.trip_id, r.source_file, ls.n, ls.s + coalesce(gst_hst, 0) + coalesce(qst, 0) AS made, coalesce(gst_hst, 0) + coalesce(qst, 0) AS tax,
  CASE WHEN CAST(substr(r.source_file, 9, 1) AS INTEGER) % 2 = 0 THEN ls.s + coalesce(gst_hst, 0) + coalesce(qst, 0) ELSE amount END AS total
  FROM receipts r JOIN ls ON ls.trip_id = r.trip_id AND ls.source_file = r.source_file),
choice AS (SELECT t.trip_id, t.source_file, es.n IS NULL OR (t.n >= 2 AND coalesce(abs(made - total) <= 0.05, false)
  AND NOT (es.n >= 2 AND coalesce(abs(es.s + tax - total) <= 0.05, false))) AS use_local
  FROM totals t LEFT JOIN es ON es.trip_id = t.trip_id AND es.source_file = t.source_file)""",
    ),
)
def _(spark, d):
    """Outside extraction of the trips below T000700 without every fifth line, every tenth one blank; every second receipt's total is that of its local lines."""
    local = alcohol.detect_alcohol(view(spark, d, "receipt_lines"))
    blank = F.when(F.col("pos") % 10 == 4, F.lit("")).otherwise(F.col("description"))
    external = alcohol.detect_alcohol(local.filter("trip_id < 'T000700' and pos % 5 <> 3").withColumn("description", blank)).withColumns(
        {"external_alcohol": F.col("pos") % 2 == 0, "external_confidence": F.lit(0.5).cast("decimal(3,2)")}
    )
    sums = local.groupBy(*KEY).agg(F.sum(F.when(F.col("description") != "GST", F.col("amount")).otherwise(0)).alias("s"))
    taxes = F.coalesce("gst_hst", F.lit(0)) + F.coalesce("qst", F.lit(0))
    whole = F.substring("source_file", 9, 1).cast("int") % 2 == 0
    receipts = view(spark, d, "receipts").join(sums, KEY).withColumn("amount", F.when(whole, F.col("s") + taxes).otherwise(F.col("amount")).cast("decimal(18,2)"))
    return receipt_text.merge_external(local, external, receipts).select(*KEY, "pos", "origin", "is_alcohol")


@query(
    "enr1_enrich_from_statement",
    oracle(
        "receipts matched_groups raw_cells",
        """, hit AS (SELECT trip_id, matched_file AS source_file, arg_min(CAST(substr(group_id, 2, 8) AS BIGINT), group_id) AS k FROM matched_groups WHERE matched_file IS NOT NULL AND match_confidence >= 0.55 GROUP BY 1, 2)
SELECT r.trip_id, r.source_file, CASE WHEN h.k IS NOT NULL AND r.description = '' THEN CASE h.k % 4 WHEN 0 THEN 'Blue Cafe' WHEN 1 THEN 'Nigel' WHEN 2 THEN 'Paper Shop' ELSE 'Plain Name' END ELSE r.description END AS vendor,
       CASE WHEN h.k % 4 IN (0, 1) THEN 'meal' ELSE r.expense_type END AS expense_type
FROM receipts r LEFT JOIN hit h ON h.trip_id = r.trip_id AND h.source_file = r.source_file""",
    ).replace("\n, hit AS", ", hit AS"),
)
def _(spark, d):
    names = view(spark, d, "raw_cells").select(
        F.concat(F.lit("g"), F.lpad(F.col("k").cast("string"), 8, "0")).alias("gkey"), "merchant_text"
    )
    best = (
        view(spark, d, "matched_groups")
        .filter("matched_file is not null")
        .withColumn("gkey", F.concat(F.lit("g"), F.substring("group_id", 2, 8)))
        .join(names, "gkey")
        .select(
            "trip_id", "group_id", F.col("matched_file").alias("source_file"), F.col("match_confidence").alias("score"),
            F.col("merchant_text").alias("description"), "transaction_date",
        )
    )
    receipts = view(spark, d, "receipts").withColumns({"vendor": F.col("description"), "review_note": F.lit("")})
    return receipt_text.enrich_from_statement(receipts, best).select(*KEY, "vendor", "expense_type")
