"""Reviewer decisions as tables overlaid on computed groups and receipts (DEC1-DEC8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.aggs import append_note
from tripledger.functions.amounts import MONEY

GROUP = ["trip_id", "group_id"]
RECEIPT = ["trip_id", "source_file"]
CONF = "decimal(6,3)"

# Fixed values
ALLOCATION_TYPES = ["purchase", "refund", "fee", "personal", "ignored"]
REIMBURSABLE_TYPES = ["purchase", "refund", "fee"]
OVERRIDE_FIELDS = [
    "receipt_date", "vendor", "description", "expense_type", "amount", "currency", "country", "province",
    "gst_hst", "qst", "gst_hst_number", "qst_number", "business_purpose", "attendees_client",
]


def prune_manual_matches(manual: DataFrame, groups: DataFrame, receipts: DataFrame) -> DataFrame:
    """Drop overrides whose group or receipt is gone; a null receipt is an explicit unmatch."""
    live = manual.join(groups.select(*GROUP), GROUP, "left_semi")
    unmatch = live.filter("source_file is null")
    return live.filter("source_file is not null").join(
        receipts.select(*RECEIPT), RECEIPT, "left_semi"
    ).select(*live.columns).unionByName(unmatch)


def apply_manual_matches(groups: DataFrame, manual: DataFrame, receipts: DataFrame) -> DataFrame:
    """DEC1: manual receipt per group replaces the automatic one (eligible groups only)."""
    kept = prune_manual_matches(manual, groups, receipts).select(
        *GROUP, F.col("source_file").alias("_file"), F.lit(True).alias("_set")
    )
    on = F.col("_set").isNotNull() & F.col("match_eligible")
    chosen = on & F.col("_file").isNotNull()
    return (
        groups.join(kept, GROUP, "left")
        .withColumns(
            {
                "override_active": F.col("_set").isNotNull(),
                "matched_file": F.when(on, F.col("_file")).otherwise(F.col("matched_file")),
                "suggested_file": F.when(chosen, F.col("_file")).otherwise(F.col("suggested_file")),
                "match_status": F.when(chosen, F.lit("manual"))
                .when(on, F.lit("unmatched"))
                .otherwise(F.col("match_status")),
                "match_confidence": F.when(chosen, F.lit(1).cast(CONF)).otherwise(F.col("match_confidence")),
                "review_reason": F.when(on, F.lit("")).otherwise(F.col("review_reason")),
            }
        )
        .drop("_set", "_file")
    )


def latest(table: DataFrame, keys: Sequence[str], stamp: str = "updated_at") -> DataFrame:
    """Newest row per key as a map-side combined aggregate."""
    rest = [c for c in table.columns if c not in keys]
    return (
        table.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(stamp), *[F.col(c) for c in rest if c != stamp])).alias("_r"))
        .select(*keys, "_r.*")
    )


def disposition_note(action: Column, note: Column, stamp: Column, duplicate: Column) -> Column:
    text = F.when(
        action == "ignore",
        F.concat(
            F.when(duplicate, F.lit("Ignored as duplicate: ")).otherwise(F.lit("Excluded from this trip: ")),
            F.coalesce(note, F.lit("")),
        ),
    ).otherwise(F.lit("Confirmed as a legitimate repeated transaction."))
    return F.when(
        stamp.isNotNull(),
        F.concat(text, F.lit(" Decision recorded "), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".")),
    ).otherwise(text)


def apply_dispositions(groups: DataFrame, dispositions: DataFrame) -> DataFrame:
    """DEC2: ignore / keep; 'unresolved' and a keep on a row that is no duplicate clear the decision."""
    decided = latest(dispositions.select(*GROUP, "action", "note", "updated_at"), GROUP).select(
        *GROUP, F.col("action").alias("_action"), F.col("note").alias("_note"), F.col("updated_at").alias("_at")
    )
    duplicate = F.col("normalization_status") == "possible_duplicate"
    joined = groups.join(decided, GROUP, "left").withColumn(
        "_do",
        F.when(F.col("_action") == "ignore", F.lit("ignore")).when(
            (F.col("_action") == "keep") & duplicate, F.lit("keep")
        ),
    )
    ignore, keep = F.coalesce(F.col("_do") == "ignore", F.lit(False)), F.coalesce(F.col("_do") == "keep", F.lit(False))
    promote = (
        keep
        & F.col("matched_file").isNull()
        & F.col("suggested_file").isNotNull()
        & (F.col("match_confidence") >= 0.72)
        & (F.col("review_reason") == "")
    )
    return joined.select(
        *[
            c
            for c in groups.columns
            if c not in ("matched_file", "match_status", "match_confidence", "normalization_status")
        ],
        ignore.alias("ignored"),
        F.when(ignore, F.lit(None)).when(promote, F.col("suggested_file")).otherwise(F.col("matched_file")).alias("matched_file"),
        F.when(ignore, F.lit("ignored")).when(promote, F.lit("auto")).otherwise(F.col("match_status")).alias("match_status"),
        F.when(ignore, F.lit(0).cast(CONF)).otherwise(F.col("match_confidence")).alias("match_confidence"),
        F.when(ignore, F.lit("ignored"))
        .when(keep, F.lit("duplicate_confirmed"))
        .otherwise(F.col("normalization_status"))
        .alias("normalization_status"),
        F.coalesce("_do", F.when(duplicate, F.lit("unresolved"))).alias("duplicate_resolution"),
        F.when(
            F.col("_do").isNotNull(), disposition_note(F.col("_do"), F.col("_note"), F.col("_at"), duplicate)
        )
        .otherwise(F.lit(""))
        .alias("decision_note"),
    )


def validate_allocations(allocations: DataFrame, groups: DataFrame, receipts: DataFrame) -> DataFrame:
    """DEC3: one row per submitted allocation with its percentage of the group and its errors."""
    known = receipts.select(*RECEIPT, F.lit(True).alias("_known"))
    target = groups.select(*GROUP, F.col("cad_amount").alias("_target"))
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    file = F.nullif(F.trim(F.coalesce("source_file", F.lit(""))), F.lit(""))
    note = F.trim(F.coalesce("note", F.lit("")))
    cad = F.col("cad_amount")
    category = F.trim(F.coalesce("category", F.lit("")))

    def err(when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(text))

    rows = (
        allocations.withColumns({"type": kind, "source_file": file, "note": note})
        .join(known, RECEIPT, "left")
        .join(target, GROUP, "left")
    )
    kind, file, note = F.col("type"), F.col("source_file"), F.col("note")
    return rows.select(
        *GROUP,
        "allocation_id",
        "type",
        "source_file",
        F.when((category == "") & (kind == "personal"), F.lit("Personal / non-reimbursable"))
        .when((category == "") & (kind == "ignored"), F.lit("Ignored"))
        .otherwise(category)
        .alias("category"),
        "original_amount",
        cad.alias("cad_amount"),
        F.when(
            F.coalesce(F.col("_target"), F.lit(0)) != 0,
            (F.abs(cad).cast("decimal(24,8)") / F.abs("_target") * 100).cast("decimal(12,4)"),
        )
        .otherwise(F.lit(0).cast("decimal(12,4)"))
        .alias("percentage"),
        "note",
        F.array_compact(
            F.array(
                err(~kind.isin(ALLOCATION_TYPES), "invalid type"),
                err(file.isNotNull() & F.col("_known").isNull(), "invoice no longer present"),
                err(kind.isin("purchase", "refund") & file.isNull(), "must reference an invoice"),
                err(kind.isin("personal", "ignored") & (note == ""), "needs an audit note"),
                err(cad.isNull(), "needs a valid CAD amount"),
                err(cad == 0, "CAD amount cannot be zero"),
                err((kind == "refund") & (cad > 0), "refund amount must be negative"),
                err((kind != "refund") & (cad < 0), "amount must be positive"),
            )
        ).alias("errors"),
    )


def allocation_totals(groups: DataFrame, allocations: DataFrame) -> DataFrame:
    """DEC4: groups with allocation total, balance and status; a split group loses its direct match."""
    sums = allocations.groupBy(*GROUP).agg(F.sum("cad_amount").cast(MONEY).alias("_sum"))
    target = F.coalesce(F.col("cad_amount"), F.lit(0)).cast(MONEY)
    balance = (target - F.col("_sum")).cast(MONEY)
    split = F.col("_sum").isNotNull()
    over = (target != 0) & ((F.signum("_sum") * F.signum(target) < 0) | (F.abs("_sum") > F.abs(target)))
    status = (
        F.when(~split, F.lit("none"))
        .when(F.abs(balance) <= 0.01, F.lit("balanced"))
        .when(over, F.lit("overallocated"))
        .otherwise(F.lit("unallocated"))
    )
    return (
        groups.join(sums, GROUP, "left")
        .withColumns(
            {
                "allocation_status": status,
                "allocation_balance": F.when(~split, F.col("cad_amount"))
                .when(status == "balanced", F.lit(0).cast(MONEY))
                .otherwise(balance),
                "allocation_total": F.coalesce("_sum", F.lit(0).cast(MONEY)),
            }
        )
        .withColumns(
            {
                "matched_file": F.when(~split, F.col("matched_file")),
                "match_status": F.when(split, F.lit("split")).otherwise(F.col("match_status")),
                "match_confidence": F.when(
                    split, F.when(F.col("allocation_status") == "balanced", F.lit(1)).otherwise(F.lit(0)).cast(CONF)
                ).otherwise(F.col("match_confidence")),
            }
        )
        .drop("_sum")
    )


def apply_field_overrides(receipts: DataFrame, overrides: DataFrame, fields: Sequence[str]) -> DataFrame:
    """DEC5: overlay edited fields; the override table is (trip, file, field, value).

    The presence of a row decides, so a null value clears the field. The narrow edits are folded
    to one map per receipt (at most one entry per field) before the join.
    """
    folded = (
        overrides.filter(F.col("field").isin(list(fields)))
        .groupBy(*RECEIPT)
        .agg(
            *[
                F.max_by(
                    F.when(F.col("field") == f, F.struct("value")),
                    F.when(F.col("field") == f, F.struct("updated_at", "value")),
                ).alias(f"_{f}")
                for f in fields
            ]
        )
    )
    joined = receipts.join(folded, RECEIPT, "left")
    types = dict(receipts.dtypes)
    return joined.select(
        *[
            F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value").try_cast(types[c]))
            .otherwise(F.col(c))
            .alias(c)
            if c in fields
            else F.col(c)
            for c in receipts.columns
        ]
    )


def issue_expense_ids(receipts: DataFrame) -> DataFrame:
    """Readable ids ``yyyymmdd_#n`` in file order within a trip.

    The number is a running position over a whole trip. It comes from a global range sort (which
    also splits one very large trip over many tasks) plus per-partition offsets, not from a
    window that would bring a trip into one task.
    """
    from tripledger.functions.ranking import positions_within

    numbered = positions_within(receipts, ["trip_id"], ["_file_key", "source_file"], {"_file_key": F.lower("source_file")})
    day = F.coalesce(F.date_format("receipt_date", "yyyyMMdd"), F.lit("yyyymmdd"))
    return numbered.withColumn(
        "expense_id", F.concat(day, F.lit("_#"), F.col("position").cast("string"))
    ).drop("position", "_file_key")


def statement_basis(receipts: DataFrame, basis: DataFrame) -> DataFrame:
    """DEC6: explicit basis decisions; a personal share needs more than one person."""
    chosen = latest(basis.filter(F.col("basis").isin("full_receipt", "personal_share")), RECEIPT)
    people = F.greatest(F.lit(1), F.coalesce(F.col("number_of_people"), F.lit(1)))
    ok = (F.col("basis") == "full_receipt") | ((F.col("basis") == "personal_share") & (people > 1))
    return receipts.join(
        chosen.select(*RECEIPT, "basis", F.col("updated_at").alias("basis_updated_at")), RECEIPT, "left"
    ).withColumn("explicit_basis", F.when(ok, F.col("basis"))).drop("basis")


def removed_receipt_cascade(decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """DEC7: drop rows of a decision table that refer to receipts that are gone (null refers to none)."""
    refers = F.col("source_file").isNotNull()
    return decisions.filter(~refers).unionByName(
        decisions.filter(refers).join(receipts.select(*RECEIPT), RECEIPT, "left_semi").select(*decisions.columns)
    )


SNAPSHOT_FIELDS = ["receipt_date", "vendor", "expense_type", "amount", "currency", "number_of_people"]
ESTIMATE_INPUTS = ["receipt_date", "amount", "currency", "number_of_people"]


def refresh_snapshot(snapshot: DataFrame, edits: DataFrame, estimates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DEC8: newer receipt fields overlay the matching snapshot; changed ones void the estimate.

    edits: full receipt rows; returns (new snapshot, surviving estimates).
    """
    new = edits.select(*RECEIPT, F.lit(True).alias("_edit"), *[F.col(f).alias(f"_{f}") for f in SNAPSHOT_FIELDS])
    joined = snapshot.join(new, RECEIPT, "left")
    changed = F.lit(False)
    for f in ESTIMATE_INPUTS:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    out = joined.select(
        *[
            F.when(F.col("_edit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in SNAPSHOT_FIELDS else F.col(c)
            for c in snapshot.columns
        ],
        (F.coalesce(F.col("_edit"), F.lit(False)) & changed).alias("estimate_void"),
    )
    survivors = estimates.join(out.filter("estimate_void").select(*RECEIPT), RECEIPT, "left_anti")
    return out, survivors


def note_dispositions(legs: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Disposition notes on the legs of decided groups, every row retained for audit."""
    decided = latest(dispositions.select(*GROUP, "action", "note", "updated_at"), GROUP).filter(
        F.col("action").isin("keep", "ignore")
    )
    joined = legs.join(decided, GROUP, "left")
    ignore = F.coalesce(F.col("action") == "ignore", F.lit(False))
    return joined.select(
        *[c for c in legs.columns if c not in ("match_eligible", "normalization_status", "review_note")],
        (F.col("match_eligible") & ~ignore).alias("match_eligible"),
        F.when(ignore, F.lit("ignored"))
        .when(F.col("action") == "keep", F.lit("duplicate_confirmed"))
        .otherwise(F.col("normalization_status"))
        .alias("normalization_status"),
        F.when(
            F.col("action").isNotNull(),
            append_note(
                F.col("review_note"),
                disposition_note(
                    F.col("action"), F.col("note"), F.col("updated_at"), F.col("normalization_status") == "possible_duplicate"
                ),
            ),
        )
        .otherwise(F.col("review_note"))
        .alias("review_note"),
    )
