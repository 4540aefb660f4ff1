"""Review merge, exceptions, validation and edits (REV1-REV14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.aggs import first_row_per_key
from tripledger.functions.amounts import MONEY, amount_bucket, lit_dec
from tripledger.functions.currencies import CURRENCY_CODES
from tripledger.functions.materialize import by_slices, materialize, release
from tripledger.functions.ranking import positions_within
from tripledger.functions.similarity import similarity_ceiling, text_similarity
from tripledger.operators.claims import RECEIPT
from tripledger.operators.lines import TAX_LABELS, receipt_id

# Fixed values
FIELD_THRESHOLD = "0.72"
LINE_THRESHOLD = "0.72"
ALCOHOL_THRESHOLD = "0.85"
FUZZY_THRESHOLD = 0.70
REQUIRED_FIELDS = {
    "receipt_date": "date", "vendor": "vendor", "amount": "total", "currency": "currency", "expense_type": "expense type",
}
FIELD_LABELS = {
    "receipt_date": "Date", "vendor": "Vendor", "description": "Description", "expense_type": "Expense type",
    "amount": "Receipt total", "currency": "Currency", "country": "Country", "province": "Province / state",
    "subtotal": "Subtotal", "gst_hst": "GST/HST", "qst": "QST", "gst_hst_number": "GST/HST number", "qst_number": "QST number",
    "business_purpose": "Business purpose", "attendees_client": "Meal attendees / client",
    "tax_documentation_status": "Tax documentation",
}
SYSTEM_FIELDS = ["gst_hst", "qst"]
PROGRAMS = {"company_reimbursed": "company", "own_company": "company", "sponsor_reimbursed": "sponsored"}
PAYERS = {"employee_personal": "traveller_personal", "corporate_card": "company_card"}


def _present(fields: dict[str, str] | list[str], df: DataFrame) -> list[str]:
    return [f for f in fields if f in df.columns]


def _long(df: DataFrame, fields: list[str], value: str) -> DataFrame:
    """(trip, file, field, value) rows; one explode instead of one scan per field."""
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    return df.select(*RECEIPT, F.explode(items).alias("x")).select(*RECEIPT, "x.field", F.col("x.v").alias(value))


def scan_status(files: DataFrame, stored: DataFrame) -> DataFrame:
    """REV11: scanned / changed / not_scanned by content hash."""
    s = stored.select(*RECEIPT, F.col("sha256").alias("_stored"))
    return files.join(s, RECEIPT, "left").withColumn(
        "status",
        F.when(F.col("_stored").isNull(), F.lit("not_scanned"))
        .when(F.col("_stored") == F.col("sha256"), F.lit("scanned"))
        .otherwise(F.lit("changed")),
    ).drop("_stored")


# ------------------------------------------------------------------ fuzzy line match


def _key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _near_buckets(amount: Column) -> Column:
    v = F.abs(amount).cast("double")
    return F.sequence(
        amount_bucket(F.least(v * 0.96, v - 0.11)), amount_bucket(F.greatest(v * 1.04, v + 0.11))
    )


def _line_kinds(lines: DataFrame, side: str) -> DataFrame:
    """Lines as they are compared: wording, amount and alcohol flag."""
    k, a, x = f"{side}k", f"{side}a", f"{side}x"
    return (
        lines.select(*RECEIPT, F.col("pos").alias(f"{side}_pos"), _key(F.col("description")).alias(k), F.col("amount").alias(a), F.coalesce("is_alcohol", F.lit(False)).alias(x))
        .filter(F.col(k) != "")
    )


def _with_kind(lines: DataFrame, side: str) -> DataFrame:
    """The kind lines belong to: equal wording, amount and alcohol flag score alike against everything."""
    kind = F.unhex(F.md5(F.to_json(F.struct(f"{side}k", f"{side}a", f"{side}x"))))
    return lines.withColumn(f"{side}_kind", kind)


def fuzzy_candidates(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs of line kinds of one receipt that score at least .70: .65 text + .30 amount + .05 alcohol.

    Without equal amounts the score needs equal texts, so the pairs come from two equi-joins: on the text, and for
    other texts on a logarithmic bucket of the amount, where pairs that no similarity of texts of their lengths
    brings to .70 are dropped. A pair meets in one of the two, and once. new, stored: tables of _with_kind.
    """
    n = materialize(new.drop("n_pos").distinct())
    s = materialize(stored.drop("s_pos").distinct())
    flag = F.when(F.col("nx") == F.col("sx"), F.lit(0.05)).otherwise(F.lit(0.0))
    tolerance = F.greatest(lit_dec("0.10"), F.greatest(F.abs("na"), F.abs("sa")) * lit_dec("0.03", "decimal(3,2)"))
    close = F.abs(F.col("na") - F.col("sa")) <= tolerance
    amount = F.when(close, F.lit(1.0)).when(F.col("na").isNull() & F.col("sa").isNull(), F.lit(0.25)).otherwise(F.lit(0.0))
    score = lambda text: F.round(F.lit(0.65) * text + F.lit(0.30) * amount + flag, 9)
    kept = lambda pairs, text: pairs.withColumn("score", score(text)).filter(F.col("score") >= FUZZY_THRESHOLD).select(
        *RECEIPT, "n_kind", "s_kind", "score"
    )
    same_text = materialize(kept(n.join(s.withColumn("nk", F.col("sk")), [*RECEIPT, "nk"]), F.lit(1.0)))
    ceiling = F.least(F.lit(1.0), similarity_ceiling(F.col("nk"), F.col("sk")) + 1e-7)
    near = (
        n.withColumn("b", F.explode(_near_buckets(F.col("na"))))
        .join(s.filter("sa is not null").withColumn("b", amount_bucket(F.abs("sa"))), [*RECEIPT, "b"])
        .filter((F.col("nk") != F.col("sk")) & close & (F.lit(0.65) * ceiling + F.lit(0.30) + flag >= FUZZY_THRESHOLD - 1e-6))
    )
    other_text = materialize(kept(near, text_similarity(F.col("nk"), F.col("sk"))))
    release(n, s)
    return same_text.unionByName(other_text)


def fuzzy_line_match(new: DataFrame, stored: DataFrame) -> DataFrame:
    """REV2: one-to-one match of new to stored lines; earlier lines choose first.

    A stored kind that only one new kind can take, and that this kind prefers to all others, is given out
    by rank: its first line to the first new line, and so on. However many equal lines a receipt
    has, they are numbered, not paired. What is contested or left over goes through rounds of
    proposals: lines propose to their best stored line, a stored line keeps the earliest proposer and
    the others lose that pair. With one common order of the proposers both give exactly the sequential choice.
    Receipts are matched in slices, so that the disk holds the pairs of one slice at a time.
    """
    n, s = materialize(_line_kinds(new, "n")), materialize(_line_kinds(stored, "s"))
    matched = by_slices(_match_lines, RECEIPT, n, s)
    release(n, s)
    return matched


def _match_lines(new: DataFrame, stored: DataFrame) -> DataFrame:
    """fuzzy_line_match of written tables of _line_kinds."""
    n, s = _with_kind(new, "n"), _with_kind(stored, "s")
    kinds = fuzzy_candidates(n, s)
    wanted_once = kinds.groupBy(*RECEIPT, "s_kind").agg(F.count("*").alias("takers")).filter("takers = 1")
    best = kinds.groupBy(*RECEIPT, "n_kind").agg(F.max("score").alias("score"))
    sole_best = kinds.join(best, [*RECEIPT, "n_kind", "score"]).groupBy(*RECEIPT, "n_kind", "score").agg(F.count("*").alias("n")).filter("n = 1")
    private = materialize(
        kinds.join(wanted_once, [*RECEIPT, "s_kind"], "left_semi").join(sole_best, [*RECEIPT, "n_kind", "score"], "left_semi")
    )
    n_ranked = positions_within(n.join(private, [*RECEIPT, "n_kind"]).select(*RECEIPT, "n_kind", "s_kind", "score", "n_pos"), [*RECEIPT, "n_kind"], ["n_pos"])
    s_ranked = positions_within(s.join(private, [*RECEIPT, "s_kind"], "left_semi").select(*RECEIPT, "s_kind", "s_pos"), [*RECEIPT, "s_kind"], ["s_pos"])
    given = materialize(
        n_ranked.join(s_ranked, [*RECEIPT, "s_kind", "position"]).select(*RECEIPT, F.col("n_pos").alias("new_pos"), F.col("s_pos").alias("stored_pos"), "score")
    )
    release(n_ranked, s_ranked)
    contested = kinds.join(private, [*RECEIPT, "n_kind", "s_kind"], "left_anti")
    open_new = n.withColumnRenamed("n_pos", "new_pos").join(given, [*RECEIPT, "new_pos"], "left_anti").select(*RECEIPT, "n_kind", "new_pos")
    pairs = materialize(
        contested.join(open_new, [*RECEIPT, "n_kind"])
        .join(s.select(*RECEIPT, "s_kind", F.col("s_pos").alias("stored_pos")), [*RECEIPT, "s_kind"])
        .select(*RECEIPT, "new_pos", "stored_pos", "score")
    )
    release(kinds, private)
    if pairs.isEmpty():
        return given
    while True:
        proposals = pairs.groupBy(*RECEIPT, "new_pos").agg(
            F.min_by(F.struct("stored_pos", "score"), F.struct((-F.col("score")).alias("s"), F.col("stored_pos"))).alias("c")
        ).select(*RECEIPT, "new_pos", "c.*")
        kept = proposals.groupBy(*RECEIPT, "stored_pos").agg(F.min("new_pos").alias("new_pos"))
        rejected = materialize(
            proposals.join(kept, [*RECEIPT, "stored_pos", "new_pos"], "left_anti").select(*RECEIPT, "new_pos", "stored_pos")
        )
        if rejected.isEmpty():
            return given.unionByName(proposals.select(given.columns))
        before, pairs = pairs, materialize(pairs.join(rejected, [*RECEIPT, "new_pos", "stored_pos"], "left_anti"))
        release(before, rejected)


# ------------------------------------------------------------------ merge and decisions

DECISION_FLAGS = ["manual", "inclusion_overridden", "alcohol_overridden"]


def preserve_line(automatic: Column, stored: Column, flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), stored).otherwise(automatic)


def merge_rescan(new: DataFrame, stored: DataFrame, removed: DataFrame, unchanged: DataFrame) -> DataFrame:
    """REV1 + REV3: new extraction with stored decisions.

    new: extracted lines with line_id; stored: reviewed lines with decision flags; removed: line
    ids a reviewer removed; unchanged: receipts whose content hash equals the stored one. Exact
    line id first, then a fuzzy match among reviewed lines; removed lines stay removed, manual
    lines stay.
    """
    live = stored.join(unchanged.select(*RECEIPT), RECEIPT, "left_semi")
    gone = removed.join(unchanged.select(*RECEIPT), RECEIPT, "left_semi")
    decided = F.lit(False)
    for f in DECISION_FLAGS:
        decided = decided | F.coalesce(F.col(f), F.lit(False))
    ids = live.select(*RECEIPT, "line_id")
    open_new = new.join(ids, [*RECEIPT, "line_id"], "left_anti")
    taken = new.select(*RECEIPT, "line_id")
    open_stored = live.filter(decided & ~F.coalesce("manual", F.lit(False))).join(taken, [*RECEIPT, "line_id"], "left_anti")
    fuzzy = fuzzy_line_match(open_new, open_stored).join(
        live.select(*RECEIPT, F.col("pos").alias("stored_pos"), F.col("line_id").alias("stored_id")), [*RECEIPT, "stored_pos"]
    ).select(*RECEIPT, F.col("new_pos").alias("pos"), "stored_id")
    s = live.select(
        *RECEIPT, F.col("line_id").alias("stored_id"), F.col("description").alias("_d"), F.col("amount").alias("_a"),
        F.col("is_alcohol").alias("_x"), F.col("in_sponsor").alias("_i"), *[F.col(f).alias(f"_{f}") for f in DECISION_FLAGS],
        F.col("reviewed").alias("_r"),
    )
    linked = new.join(fuzzy, [*RECEIPT, "pos"], "left").withColumn("stored_id", F.coalesce("stored_id", "line_id"))
    kept = linked.join(s, [*RECEIPT, "stored_id"], "left").join(gone.select(*RECEIPT, "line_id"), [*RECEIPT, "line_id"], "left_anti")
    hit = F.coalesce(F.col("_d"), F.lit("")) != ""
    merged = kept.select(
        *RECEIPT, "pos", "line_id",
        F.when(hit, F.col("_d")).otherwise(F.col("description")).alias("description"),
        F.coalesce("_a", "amount").alias("amount"),
        preserve_line(F.col("is_alcohol"), F.col("_x"), F.col("_alcohol_overridden")).alias("is_alcohol"),
        preserve_line(~F.col("is_alcohol"), F.col("_i"), F.col("_inclusion_overridden")).alias("in_sponsor"),
        F.coalesce("_r", F.lit(False)).alias("reviewed"),
        F.lit(False).alias("manual"),
        *[F.coalesce(F.col(f"_{f}"), F.lit(False)).alias(f) for f in DECISION_FLAGS if f != "manual"],
    )
    manual = live.filter("manual").join(gone.select(*RECEIPT, "line_id"), [*RECEIPT, "line_id"], "left_anti").select(*merged.columns)
    return merged.unionByName(manual.join(taken, [*RECEIPT, "line_id"], "left_anti"))


def extraction_changes(before: DataFrame, after: DataFrame, overrides: DataFrame) -> DataFrame:
    """REV4: fields whose automatic value changed by more than a cent or in wording.

    overrides: (trip, file, field) of values a reviewer set.
    """
    fields = [f for f in FIELD_LABELS if f in before.columns and f in after.columns]
    old, new = _long(before, fields, "before"), _long(after, fields, "after")
    j = old.join(new, [*RECEIPT, "field"])
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    num = lambda c: F.col(c).try_cast("decimal(18,2)")
    numeric = num("before").isNotNull() & num("after").isNotNull() & F.col("field").isin("amount", "subtotal", "gst_hst", "qst")
    differs = F.when(numeric, F.abs(num("before") - num("after")) > lit_dec("0.01")).otherwise(tidy("before") != tidy("after"))
    changed = j.filter(differs)
    mine = overrides.select(*RECEIPT, "field").distinct().withColumn("preserved_user_value", F.lit(True))
    return changed.join(mine, [*RECEIPT, "field"], "left").withColumn(
        "preserved_user_value", F.coalesce("preserved_user_value", F.lit(False))
    )


def _snapshot(lines: DataFrame) -> DataFrame:
    """Extracted purchase lines as they are compared: wording without extra blanks, whole cents, automatic alcohol flag."""
    kept = lines.filter(~F.coalesce(F.col("line_type").isin(SYSTEM_FIELDS), F.lit(False))) if "line_type" in lines.columns else lines
    return kept.select(
        *RECEIPT, "pos",
        F.struct(
            F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " ")).alias("d"), F.col("amount").cast(MONEY).alias("a"),
            F.coalesce("is_alcohol", F.lit(False)).alias("x"),
        ).alias("line"),
    )


def _digest(snapshot: DataFrame, name: str) -> DataFrame:
    """An ordered digest of each receipt's lines: their number, and the sums of their hashes and of those weighted by place.

    Sums of halves of the hash, so nothing overflows and parts combine before the shuffle.
    """
    h = F.xxhash64("line")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    at = F.pmod(F.xxhash64("pos"), F.lit(1_000_003)).cast("decimal(20,0)")
    sums = [F.sum(x.cast("decimal(20,0)")) for x in (low, high)] + [F.sum((x.cast("decimal(20,0)") * at).cast("decimal(30,0)")) for x in (low, high)]
    return snapshot.groupBy(*RECEIPT).agg(F.concat_ws("|", F.count("*").cast("string"), *[x.cast("string") for x in sums]).alias(name))


def line_changes(before: DataFrame, after: DataFrame, decided: DataFrame) -> DataFrame:
    """REV4, lines: receipts whose extracted lines differ in wording, amount, alcohol flag or order, with both as text.

    before, after: extracted lines (pos, description, amount, is_alcohol, line_type); decided: (trip, file) of receipts with
    lines that a reviewer decided. Only receipts whose digests differ are gathered and compared in order; they are written
    once, so the digests leave the disk before any lines are gathered.
    """
    old, new = _snapshot(before), _snapshot(after)
    differ = materialize(
        _digest(old, "_old").join(_digest(new, "_new"), RECEIPT, "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*RECEIPT)
    )

    def packed(snapshot: DataFrame, name: str) -> DataFrame:
        rows = snapshot.join(differ, RECEIPT, "left_semi").groupBy(*RECEIPT).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
        return rows.select(*RECEIPT, F.col("l.line").alias(name))

    def shown(lines: Column) -> Column:
        one = lambda x: F.concat(
            F.when(x["d"] == "", F.lit("Unnamed line")).otherwise(x["d"]), F.lit(" — "), F.coalesce(x["a"].cast("string"), F.lit("amount missing"))
        )
        return F.when(F.size(F.coalesce(lines, F.array())) <= 0, F.lit("No extracted purchase lines")).otherwise(F.array_join(F.transform(lines, one), "; "))

    both = differ.join(packed(old, "_b"), RECEIPT, "left").join(packed(new, "_a"), RECEIPT, "left").filter(~F.col("_b").eqNullSafe(F.col("_a")))
    mine = decided.select(*RECEIPT).distinct().withColumn("preserved_user_value", F.lit(True))
    return both.join(mine, RECEIPT, "left").select(
        *RECEIPT, F.lit("line_items").alias("field"), shown(F.col("_b")).alias("before"), shown(F.col("_a")).alias("after"),
        F.coalesce("preserved_user_value", F.lit(False)).alias("preserved_user_value"),
    )


def field_evidence(receipts: DataFrame) -> DataFrame:
    """REV5: confidence and reason per extracted field (explicit maps win over the receipt's score)."""
    fields = _present(FIELD_LABELS, receipts)
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    given = F.try_element_at("field_confidence", F.col("field")) if "field_confidence" in receipts.columns else F.lit(None).cast("double")
    why = F.try_element_at("field_reasons", F.col("field")) if "field_reasons" in receipts.columns else F.lit(None).cast("string")
    keep = [c for c in ("field_confidence", "field_reasons") if c in receipts.columns]
    rows = receipts.select(*RECEIPT, "confidence", *keep, F.explode(items).alias("x")).select(*RECEIPT, "confidence", *keep, "x.*")
    blank = F.coalesce("value", F.lit("")) == ""
    required = F.col("field").isin(list(REQUIRED_FIELDS))
    system = F.col("field").isin(SYSTEM_FIELDS)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    score = F.round(
        F.when(given.isNotNull(), clip(given))
        .when(system, 1.0)
        .when(blank, F.when(required, 0.0).otherwise(1.0))
        .otherwise(clip(F.coalesce("confidence", F.lit(0.0)))),
        4,
    )
    percent = F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))
    reason = F.coalesce(
        F.nullif(why, F.lit("")),
        F.when(blank, F.when(required, F.lit("No value was extracted.")).otherwise(F.lit("No optional value was present in the extraction.")))
        .when(system, F.lit("Derived deterministically from the receipt review contract."))
        .otherwise(F.concat(F.lit("Extractor reported "), percent, F.lit(" confidence for this receipt."))),
    )
    return rows.select(*RECEIPT, "field", "value", score.alias("field_confidence"), F.left(reason, F.lit(240)).alias("reason"))


def receipt_exceptions(
    receipts: DataFrame, evidence: DataFrame, lines: DataFrame, totals: DataFrame, changes: DataFrame | None = None
) -> DataFrame:
    """REV6: unresolved extraction problems, one rule per branch.

    receipts: reviewed flag; lines: line_id, alcohol_confidence, reviewed, manual; totals: LIN7;
    a receipt in sponsored trips (claim_program) also checks uncertain alcohol.
    """
    r = receipts.select(*RECEIPT, F.coalesce("reviewed", F.lit(False)).alias("_rev"), F.col("claim_program").alias("_program"))
    out = [*RECEIPT, "exception_id", "category", "severity", "message"]
    rid = receipt_id()

    def rows(df: DataFrame, suffix: Column, category: Column, severity: Column, message: Column) -> DataFrame:
        return df.select(
            *RECEIPT, F.concat_ws(":", rid, suffix).alias("exception_id"), category.alias("category"), severity.alias("severity"), message.alias("message")
        ).select(out)

    value = F.coalesce("value", F.lit(""))
    missing = F.col("field").isin(list(REQUIRED_FIELDS)) & value.isin("", "Unknown supplier")
    faint = (value != "") & (F.col("field_confidence") < float(FIELD_THRESHOLD))
    # only rows that may become an exception meet their receipt
    e = evidence.filter(missing | faint).join(r, RECEIPT)
    field_rows = rows(
        e.filter(missing | (faint & ~F.col("_rev"))),
        F.concat(F.lit("field:"), F.col("field"), F.when(missing, F.lit(":missing")).otherwise(F.lit(":confidence"))),
        F.when(missing, F.lit("missing_field")).otherwise(F.lit("low_confidence_field")),
        F.when(missing, F.lit("blocking")).otherwise(F.lit("review")),
        F.when(missing, F.concat(F.col("field"), F.lit(" is required before finalization."))).otherwise(
            F.concat(F.col("field"), F.lit(" has "), F.round(F.col("field_confidence") * 100).cast("int").cast("string"), F.lit("% extraction confidence."))
        ),
    )
    system = F.col("line_type").isin(list(TAX_LABELS))
    manual = F.coalesce("manual", F.lit(False))
    seen = F.coalesce(F.col("line_reviewed"), F.lit(False))
    incomplete = (F.trim(F.coalesce("description", F.lit(""))) == "") | F.col("amount").isNull()
    doubtful = (
        ~system & ~manual & ~seen
        & (F.coalesce("alcohol_confidence", F.lit(0)) > 0) & (F.col("alcohol_confidence") < lit_dec(ALCOHOL_THRESHOLD))
    )
    unsure = (F.col("_program") == "sponsored") & doubtful
    weak = ~system & ~manual & ~seen & (F.coalesce("confidence", F.lit(0.0)) < float(LINE_THRESHOLD))
    kind = F.when(incomplete, F.lit("missing_line_value")).when(unsure, F.lit("uncertain_alcohol")).when(weak, F.lit("low_confidence_line"))
    ln = lines.filter(incomplete | doubtful | weak).join(r, RECEIPT)
    line_rows = rows(
        ln.withColumn("_kind", kind).filter("_kind is not null"),
        F.concat(F.lit("line:"), F.col("line_id"), F.lit(":"), F.col("_kind")),
        F.col("_kind"),
        F.when(F.col("_kind") == "missing_line_value", F.lit("blocking")).otherwise(F.lit("review")),
        F.concat(F.lit("Check line: "), F.coalesce("description", F.lit(""))),
    )
    total_rows = rows(
        totals.filter(F.abs("difference") > lit_dec("0.05")),
        F.lit("line-total"),
        F.lit("line_total_difference"),
        F.when(F.col("blocking"), F.lit("blocking")).otherwise(F.lit("review")),
        F.concat(F.lit("Extracted lines differ from the receipt total by "), F.col("difference").cast("string"), F.lit(".")),
    )
    united = field_rows.unionByName(line_rows).unionByName(total_rows)
    if changes is not None:
        united = united.unionByName(
            rows(
                changes, F.concat(F.lit("change:field:"), F.col("field")), F.lit("extraction_change"), F.lit("review"),
                F.concat(F.lit("Extraction changed: "), F.col("field")),
            )
        )
    return united


def duplicate_receipts(receipts: DataFrame) -> DataFrame:
    """REV7: later receipts with the same date, vendor key, amount and currency as an earlier one.

    The first receipt per key is an aggregate joined back; no key is gathered.
    """
    keyed = receipts.withColumns(
        {
            "_v": F.regexp_replace(F.lower(F.coalesce("vendor", F.lit(""))), "[^a-z0-9]+", ""),
            "_c": F.upper(F.coalesce("currency", F.lit(""))),
            "_f": F.lower("source_file"),
        }
    ).filter("receipt_date is not null and _v <> '' and _c <> '' and amount is not null")
    keys = ["trip_id", "receipt_date", "_v", "amount", "_c"]
    first = keyed.groupBy(*keys).agg(
        F.min(F.struct("_f", "source_file")).alias("_first"), F.count("*").alias("_n")
    ).filter("_n > 1")
    return keyed.join(first, keys).filter(F.col("source_file") != F.col("_first.source_file")).select(
        *RECEIPT, F.col("_first.source_file").alias("duplicate_of")
    )


def review_summary(receipts: DataFrame, exceptions: DataFrame) -> DataFrame:
    """REV8: counters per trip; an exception id counts once; a receipt takes its worst severity."""
    unique = first_row_per_key(exceptions, ["trip_id", "exception_id"], ["severity", "category", "message"])
    per_receipt = unique.groupBy(*RECEIPT).agg(
        F.count_if(F.col("severity") == "blocking").alias("_b"), F.count_if(F.col("severity") == "review").alias("_r")
    )
    j = receipts.select(*RECEIPT).join(per_receipt, RECEIPT, "left").na.fill(0, ["_b", "_r"])
    return j.groupBy("trip_id").agg(
        F.count("*").alias("receipt_count"),
        F.count_if(F.col("_b") > 0).alias("blocking_receipts"),
        F.count_if((F.col("_b") == 0) & (F.col("_r") > 0)).alias("review_receipts"),
        F.count_if((F.col("_b") == 0) & (F.col("_r") == 0)).alias("ready_receipts"),
        F.sum("_b").alias("exception_blocking_count"),
        F.sum("_r").alias("exception_review_count"),
    )


def exception_queue(exceptions: DataFrame) -> DataFrame:
    """REV8: ordered queue, blocking first (a global range sort, for sinks)."""
    unique = first_row_per_key(exceptions, ["trip_id", "exception_id"], ["severity", "category", "message"])
    return unique.orderBy("trip_id", F.when(F.col("severity") == "blocking", 0).otherwise(1), F.lower("source_file"), "category")


def validate_receipts(receipts: DataFrame) -> DataFrame:
    """REV9: error list per receipt; a changed subtotal recomputes the total (``old_subtotal``, ``old_amount``)."""
    zero = F.lit(0).cast(MONEY)
    taxes = F.coalesce("gst_hst", zero) + F.coalesce("qst", zero)
    if "old_subtotal" in receipts.columns:
        moved = F.col("subtotal").isNotNull() & ~F.col("subtotal").eqNullSafe(F.col("old_subtotal")) & F.col("amount").eqNullSafe(F.col("old_amount"))
        receipts = receipts.withColumn("amount", F.when(moved, (F.col("subtotal") + taxes).cast(MONEY)).otherwise(F.col("amount")))

    def err(when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(text))

    cur = F.upper(F.coalesce("currency", F.lit("")))
    note = F.trim(F.coalesce(F.col("manual_cad_note"), F.lit(""))) if "manual_cad_note" in receipts.columns else F.lit("")
    negative = F.lit(False)
    for c in ("amount", "subtotal", "gst_hst", "qst"):
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    return receipts.withColumn(
        "errors",
        F.array_compact(
            F.array(
                err((cur != "") & ~cur.isin(CURRENCY_CODES), "currency"),
                err(negative, "negative amount"),
                err(taxes > F.col("amount"), "tax above total"),
                err((F.col("number_of_people") < 1) | (F.col("number_of_people") > 99), "number of people"),
                err(F.col("manual_cad") <= 0, "manual CAD amount"),
                err(F.col("manual_cad").isNotNull() & (note == ""), "manual CAD note"),
            )
        ),
    )


def apply_edits(receipts: DataFrame, edits: DataFrame) -> DataFrame:
    """REV10: append-only edit log to current values.

    edits: trip_id, source_file, kind (set | reset), field, value, edited_at. Sets before the last
    reset of their receipt are void; the newest set of a field wins.
    """
    from tripledger.operators.decisions import apply_field_overrides

    resets = edits.filter("kind = 'reset'").groupBy(*RECEIPT).agg(F.max("edited_at").alias("_reset"))
    sets = (
        edits.filter("kind = 'set'")
        .join(resets, RECEIPT, "left")
        .filter(F.col("_reset").isNull() | (F.col("edited_at") > F.col("_reset")))
        .select(*RECEIPT, "field", "value", F.col("edited_at").alias("updated_at"))
    )
    fields = [c for c in receipts.columns if c in FIELD_LABELS or c in ("paid_by", "number_of_people", "manual_cad", "in_sponsor")]
    return apply_field_overrides(receipts, sets, fields)


def edited_lines(lines: DataFrame, line_edits: DataFrame) -> DataFrame:
    """REV10 for lines: added lines appended, removed line ids dropped, the newest action per line wins.

    line_edits: trip_id, source_file, line_id, kind (add | remove | restore), description, amount, edited_at.
    """
    newest = line_edits.groupBy(*RECEIPT, "line_id").agg(
        F.max_by(F.struct("kind", "description", "amount"), F.struct("edited_at", "kind")).alias("e")
    ).select(*RECEIPT, "line_id", "e.*")
    kept = lines.join(newest.filter("kind = 'remove'"), [*RECEIPT, "line_id"], "left_anti")
    added = newest.filter("kind = 'add'").select(
        *RECEIPT, "line_id", "description", F.col("amount").cast(MONEY).alias("amount")
    )
    return kept.unionByName(added, allowMissingColumns=True)


def metadata_rules(trips: DataFrame) -> DataFrame:
    """REV12: trip metadata with legacy codes mapped, its errors and the required gaps."""
    from tripledger.functions.cleaners import literal_map

    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    program = F.coalesce(literal_map(PROGRAMS)[low("claim_program")], low("claim_program"))
    payer = F.coalesce(literal_map(PAYERS)[low("default_paid_by")], F.nullif(low("default_paid_by"), F.lit("")), F.lit("traveller_personal"))
    err = lambda c, t: F.when(F.coalesce(c, F.lit(False)), F.lit(t))
    t = trips.withColumns({"claim_program": program, "default_paid_by": payer})
    buffer = F.coalesce("buffer_days", F.lit(0)) if "buffer_days" in trips.columns else F.lit(0)
    limit = F.col("meal_limit") if "meal_limit" in trips.columns else F.lit(None).cast(MONEY)
    return t.withColumns(
        {
            "errors": F.array_compact(
                F.array(
                    err(F.col("start_date") > F.col("end_date"), "end before start"),
                    err((F.col("claim_program") != "") & ~F.col("claim_program").isin("company", "sponsored"), "program"),
                    err(~F.col("default_paid_by").isin("traveller_personal", "company_card"), "payer"),
                    err((buffer < 0) | (buffer > 60), "coverage buffer"),
                    err(limit < 0, "meal limit"),
                )
            ),
            "gaps": F.array_compact(
                F.array(
                    err(F.col("claim_program") == "", "reimbursement program"),
                    err(F.trim(F.coalesce("traveller", F.lit(""))) == "", "traveller"),
                )
            ),
        }
    )


def apply_purpose(receipts: DataFrame, trips: DataFrame) -> DataFrame:
    """REV12: the trip's purpose fills receipts without one."""
    p = trips.select("trip_id", F.col("business_purpose").alias("_p"))
    return receipts.join(p, "trip_id", "left").withColumn(
        "business_purpose", F.coalesce(F.nullif("business_purpose", F.lit("")), "_p")
    ).drop("_p")


def profile_rules(profiles: DataFrame) -> DataFrame:
    """REV13: defaults overlaid by the given profile, with the errors found."""
    from tripledger.operators.claims import DEFAULT_ACCOUNTS, DEFAULT_RATES, default_mapping

    err = lambda c, t: F.when(F.coalesce(c, F.lit(False)), F.lit(t))
    merged = F.map_from_entries(
        F.transform(
            F.map_entries(default_mapping()),
            lambda e: F.struct(e["key"], F.coalesce(F.try_element_at("account_mapping", e["key"]), e["value"]).alias("value")),
        )
    )
    known = F.array(*[F.lit(k) for k in DEFAULT_ACCOUNTS])
    unknown = F.size(F.array_except(F.coalesce(F.map_keys("account_mapping"), F.array().cast("array<string>")), known)) > 0
    checks = [err((F.col(k) < 0) | (F.col(k) > 1), f"{k} must be between 0 and 1") for k in DEFAULT_RATES]
    return profiles.withColumn("_m", merged).withColumn(
        "errors",
        F.array_compact(
            F.array(*checks, err(unknown, "unknown account mapping"), err(F.exists(F.map_values("_m"), lambda v: F.trim(v) == ""), "account required"))
        ),
    ).withColumns(
        {**{k: F.coalesce(F.col(k), F.lit(v)).cast("decimal(7,6)") for k, v in DEFAULT_RATES.items()}, "account_mapping": F.col("_m")}
    ).drop("_m")


AUTO_NOTE = r"(?:Line items total \S+ differs from receipt total \S+; review line items/alcohol\.|No reliable meal line items extracted; review alcohol manually\.)\s*"


def reviewed_receipts(receipts: DataFrame, totals: DataFrame) -> DataFrame:
    """REV14: review applied to the receipts of the active programme; settled automatic notes removed."""
    t = totals.select(
        *RECEIPT, "line_total", "company_included_total", "sponsor_included_total", "claimable_ratio", "reconciled",
        F.col("claim_program").alias("_program"),
    )
    j = receipts.join(t, RECEIPT)
    sponsored = F.col("_program") == "sponsored"
    note = F.coalesce("review_note", F.lit(""))
    return j.withColumns(
        {
            "included": F.when(sponsored, F.col("in_sponsor") & F.col("in_company")).otherwise(F.col("in_company")),
            "included_total": F.when(sponsored, F.col("sponsor_included_total")).otherwise(F.col("company_included_total")),
            "review_note": F.when(F.col("reconciled"), F.trim(F.regexp_replace(note, AUTO_NOTE, ""))).otherwise(note),
        }
    ).drop("_program")
