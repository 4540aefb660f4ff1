"""Record linkage of receipts and card groups (JOIN*, SCR*, RNK*, INC1).

No step pairs every receipt of a trip with every group. A pair can only reach the suggestion
threshold with evidence, and each kind of evidence is an equi-join of *distinct feature rows*:

* date      - (trip, vendor, day) x (trip, description, day), day exploded by the date band;
* amount    - (trip, currency, share, vendor) x (trip, amounts, description) on a logarithmic
              amount bucket;
* date+amount - the same bucket and the exploded day together;
* words     - (trip, vendor) x (trip, description) on the first three letters of a vendor word,
              since text alone reaches the threshold only with a word hit.

Scores of the coarser joins leave the other evidence out, so they are lower bounds that the
finer joins replace: the maximum over the four is the exact score. Rows with equal features have
equal scores, hence only the earliest receipt of a feature row matters for a best match. A key
with very many rows is thereby reduced before the shuffle and never multiplied out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.functions.amounts import (
    SHARE,
    amount_bucket,
    card_gap_percent,
    close_amount,
    close_fx_amount,
    close_fx_buckets,
    days_apart,
    has_card_gap,
    lit_dec,
    per_person_share,
    receipt_buckets_for_card,
    split_people,
)
from tripledger.functions.materialize import by_slices, grown, materialize, multiplied
from tripledger.functions.similarity import similarity_ceiling, text_similarity, token_hit

SCORE = "decimal(12,8)"


@dataclass(frozen=True)
class Weights:
    """Points per kind of evidence of one scoring rule."""

    same_day: str
    day_start: str
    day_step: str
    day_floor: str
    day_band: int
    exact: str
    fx: str
    number: str | None
    gap: str
    same_day_exact: str
    similarity: str
    word: str


CARD_CENTRIC = Weights("0.30", "0.24", "0.05", "0.00", 3, "0.36", "0.46", "0.18", "0.22", "0.08", "0.34", "0.12")
RECEIPT_CENTRIC = Weights("0.35", "0.28", "0.05", "0.05", 5, "0.55", "0.55", None, "0.25", "0.05", "0.25", "0.10")
SUGGEST = "0.35"  # fixed value: lowest score that is kept
AUTO = "0.72"  # fixed value: lowest score that is assigned without review


def _d(value: str) -> Column:
    return F.lit(value).cast(SCORE)


def _zero() -> Column:
    return _d("0")


# ------------------------------------------------------------------ score parts


def date_points(w: Weights, gap_days: Column) -> Column:
    band = F.greatest(_d(w.day_floor), _d(w.day_start) - gap_days * _d(w.day_step))
    return (
        F.when(gap_days == 0, _d(w.same_day))
        .when(gap_days <= w.day_band, band.cast(SCORE))
        .otherwise(_zero())
    )


def _same_currency_close() -> Column:
    return F.coalesce(
        (F.col("currency") != "")
        & (F.col("currency") == F.col("purchase_currency"))
        & close_amount(F.col("share"), F.col("purchase_abs")),
        F.lit(False),
    )


def _cad_close() -> Column:
    return F.coalesce(
        (F.col("currency") == "CAD") & close_amount(F.col("share"), F.col("cad_abs")), F.lit(False)
    )


def _fx_close() -> Column:
    return F.coalesce(close_fx_amount(F.col("estimated_cad"), F.col("cad_abs")), F.lit(False))


def _number_close() -> Column:
    return F.coalesce(close_amount(F.col("share"), F.col("cad_abs")), F.lit(False))


def card_side() -> Column:
    """The card amount a receipt is compared with for a tax or tip gap."""
    return F.when(
        (F.col("currency") != "") & (F.col("currency") == F.col("purchase_currency")),
        F.col("purchase_abs"),
    ).when(F.col("currency") == "CAD", F.col("cad_abs"))


def amount_points(w: Weights) -> tuple[Column, Column]:
    """(points, exact?) of the amount evidence between the receipt and card columns of a pair."""
    gap = has_card_gap(F.col("share"), card_side())
    known = F.col("share").isNotNull()
    exact = known & (_same_currency_close() | _cad_close())
    fx = known & _fx_close()
    number = known & _number_close() if w.number else F.lit(False)
    points = (
        F.when(exact, _d(w.exact))
        .when(fx, _d(w.fx))
        .when(number, _d(w.number or "0"))
        .when(known & gap, _d(w.gap))
        .otherwise(_zero())
    )
    return points, exact | fx | number


def text_points(w: Weights, similarity: Column, hit: Column) -> Column:
    sim = similarity.cast("decimal(9,8)") * F.lit(w.similarity).cast("decimal(3,2)")
    return (sim.cast(SCORE) + F.when(hit, _d(w.word)).otherwise(_zero())).cast(SCORE)


def capped(points: Column) -> Column:
    return F.least(points, _d("1")).cast(SCORE)


def score_pairs(pairs: DataFrame, w: Weights) -> DataFrame:
    """SCR1 / SCR3 for rows that carry both sides' columns; adds similarity, hit and score."""
    points, exact = amount_points(w)
    gap_days = days_apart(F.col("receipt_date"), F.col("transaction_date"))
    base = (
        date_points(w, gap_days)
        + points
        + F.when((gap_days == 0) & exact, _d(w.same_day_exact)).otherwise(_zero())
    )
    return (
        pairs.withColumn("similarity", text_similarity(F.col("vendor"), F.col("description")))
        .withColumn("word_hit", token_hit(F.col("vendor"), F.col("description")))
        .withColumn("score", capped(base + text_points(w, F.col("similarity"), F.col("word_hit"))))
    )


def score_pairs_permissive(pairs: DataFrame) -> DataFrame:
    """SCR2: older rule for rows with a foreign and a CAD amount, with split-bill evidence."""
    w = CARD_CENTRIC
    share, foreign, cad = F.col("share"), F.col("purchase_amount"), F.col("cad_amount")
    cur = F.upper(F.coalesce(F.col("currency"), F.lit("")))
    is_cad = cur == "CAD"

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    card = F.when(
        foreign.isNotNull() & (cur == F.upper(F.coalesce("purchase_currency", F.lit("")))), foreign
    ).when(is_cad, cad)
    exact = yes(close_amount(share, foreign))
    split = split_people(share, foreign).isNotNull()
    exact_cad = yes(is_cad & close_amount(share, cad))
    split_cad = is_cad & split_people(share, cad).isNotNull()
    number = yes(close_amount(share, cad))
    known = share.isNotNull()
    points = (
        F.when(known & exact, _d("0.36"))
        .when(known & split, _d("0.28"))
        .when(known & exact_cad, _d("0.36"))
        .when(known & split_cad, _d("0.28"))
        .when(known & number, _d("0.18"))
        .when(known & has_card_gap(share, card), _d("0.22"))
        .otherwise(_zero())
    )
    is_exact = exact | (~split & (exact_cad | (~split_cad & number)))
    gap_days = days_apart(F.col("receipt_date"), F.col("transaction_date"))
    base = (
        date_points(w, gap_days)
        + points
        + F.when((gap_days == 0) & known & is_exact, _d("0.08")).otherwise(_zero())
    )
    return (
        pairs.withColumn("similarity", text_similarity(F.col("vendor"), F.col("description")))
        .withColumn("word_hit", token_hit(F.col("vendor"), F.col("description")))
        .withColumn("score", capped(base + text_points(w, F.col("similarity"), F.col("word_hit"))))
    )


# ------------------------------------------------------------------ sides


def receipt_side(receipts: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """Receipts with the columns scoring uses; ``file_key`` is the order that breaks ties."""
    out = receipts
    if estimates is not None:
        out = out.join(
            grown(estimates.select("trip_id", "source_file", "estimated_cad")), ["trip_id", "source_file"], "left"
        )
    elif "estimated_cad" not in receipts.columns:
        out = out.withColumn("estimated_cad", F.lit(None).cast("decimal(18,2)"))
    return out.select(
        "trip_id",
        "source_file",
        F.lower("source_file").alias("file_key"),
        "receipt_date",
        F.lower(F.coalesce("vendor", F.lit(""))).alias("vendor"),
        F.coalesce(F.col("currency"), F.lit("")).alias("currency"),
        per_person_share(F.col("amount"), F.col("number_of_people")).alias("share"),
        "estimated_cad",
    )


CARD_FEATURES = ["transaction_date", "description", "purchase_abs", "purchase_currency", "cad_abs"]


def card_rows(groups: DataFrame) -> DataFrame:
    """Eligible groups with their features and a digest of them."""
    out = groups.filter("match_eligible").select(
        "trip_id",
        "group_id",
        "transaction_date",
        F.lower(F.coalesce("description", F.lit(""))).alias("description"),
        F.abs("purchase_amount").alias("purchase_abs"),
        F.coalesce("purchase_currency", F.lit("")).alias("purchase_currency"),
        F.abs("cad_amount").alias("cad_abs"),
        "clean_legs",
    )
    return out.withColumn("card_key", F.md5(F.to_json(F.struct(*CARD_FEATURES))))


# ------------------------------------------------------------------ evidence joins


def _earliest(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct feature rows with their earliest receipt (combined before the shuffle)."""
    return receipts.groupBy("trip_id", *keys).agg(
        F.min(F.struct("file_key", "source_file")).alias("first")
    )


def _first_group(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct card feature rows with their first group."""
    return cards.groupBy("trip_id", *keys).agg(F.min("group_id").alias("first_group"))


def _near_days(rows: DataFrame, band: int) -> DataFrame:
    return rows.filter(F.col("receipt_date").isNotNull()).withColumn(
        "transaction_date",
        F.explode(F.sequence(F.date_sub("receipt_date", band), F.date_add("receipt_date", band))),
    )


def _day_block(day: Column, band: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(2 * band + 1)).cast("int")


def _card_blocks(rows: DataFrame, band: int) -> DataFrame:
    """Card rows in the one or two day blocks that dates within the band can fall into."""
    ends = F.array_distinct(
        F.array(
            _day_block(F.date_sub("transaction_date", band), band), _day_block(F.date_add("transaction_date", band), band)
        )
    )
    return rows.filter(F.col("transaction_date").isNotNull()).withColumn("block", F.explode(ends))


def _receipt_amount_keys(rows: DataFrame, w: Weights) -> DataFrame:
    """One row per way a receipt amount can agree with a card amount, with its bucket."""
    share = amount_bucket(F.col("share"))
    ways = [
        F.struct(F.concat(F.lit("own:"), F.col("currency")).alias("way"), share.alias("bucket")),
        F.struct(
            F.when(F.col("currency") == "CAD", F.lit("cad:CAD")).alias("way"), share.alias("bucket")
        ),
        F.struct(
            F.when(F.col("estimated_cad").isNotNull(), F.lit("fx")).alias("way"),
            amount_bucket(F.col("estimated_cad")).alias("bucket"),
        ),
    ]
    if w.number:
        ways.append(F.struct(F.lit("number").alias("way"), share.alias("bucket")))
    return (
        rows.filter("share is not null")
        .withColumn("_w", F.explode(F.array(*ways)))
        .withColumn("way", F.col("_w.way"))
        .withColumn("bucket", F.col("_w.bucket"))
        .filter("way is not null and way <> 'own:'")
        .drop("_w")
    )


def _card_amount_keys(rows: DataFrame, w: Weights) -> DataFrame:
    def run(way: Column, buckets: Column, present: Column) -> Column:
        return F.when(
            present,
            F.transform(buckets, lambda b: F.struct(way.alias("way"), b.alias("bucket"))),
        ).otherwise(F.array().cast("array<struct<way:string,bucket:int>>"))

    own, cad = F.col("purchase_abs"), F.col("cad_abs")
    parts = [
        run(
            F.concat(F.lit("own:"), F.col("purchase_currency")),
            receipt_buckets_for_card(own),
            own.isNotNull() & (F.col("purchase_currency") != ""),
        ),
        run(F.lit("cad:CAD"), receipt_buckets_for_card(cad), cad.isNotNull()),
        run(F.lit("fx"), close_fx_buckets(cad), cad.isNotNull()),
    ]
    if w.number:
        near = F.sequence(
            amount_bucket(F.least(cad.cast("double") * 0.98, cad.cast("double") - 0.04)),
            amount_bucket(F.greatest(cad.cast("double") * 1.02, cad.cast("double") + 0.04)),
        )
        parts.append(run(F.lit("number"), near, cad.isNotNull()))
    return (
        rows.withColumn("_w", F.explode(F.concat(*parts)))
        .withColumn("way", F.col("_w.way"))
        .withColumn("bucket", F.col("_w.bucket"))
        .drop("_w")
    )


def _vendor_words(rows: DataFrame) -> DataFrame:
    words = F.array_distinct(
        F.transform(
            F.filter(F.split("vendor", r"\s+"), lambda t: F.length(t) > 2),
            lambda t: F.left(t, F.lit(3)),
        )
    )
    return rows.withColumn("gram", F.explode(words))


def _description_grams(rows: DataFrame) -> DataFrame:
    grams = F.when(
        F.length("description") > 2,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length("description") - 2),
                lambda i: F.substring(F.col("description"), i, F.lit(3)),
            )
        ),
    )
    return rows.withColumn("gram", F.explode(grams))


def _no_amounts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "share": F.lit(None).cast(SHARE),
            "estimated_cad": F.lit(None).cast("decimal(18,2)"),
            "currency": F.lit(""),
            "purchase_abs": F.lit(None).cast("decimal(18,2)"),
            "purchase_currency": F.lit(""),
            "cad_abs": F.lit(None).cast("decimal(18,2)"),
        }
    )


def _reachable(pairs: DataFrame, w: Weights) -> DataFrame:
    """Drop pairs that cannot reach the threshold even with the best similarity their lengths allow."""
    points, exact = amount_points(w)
    gap_days = days_apart(F.col("receipt_date"), F.col("transaction_date"))
    ceiling = (
        date_points(w, gap_days)
        + points
        + F.when((gap_days == 0) & exact, _d(w.same_day_exact)).otherwise(_zero())
        + text_points(
            w,
            F.least(F.lit(1.0), similarity_ceiling(F.col("vendor"), F.col("description")) + 1e-7),
            token_hit(F.col("vendor"), F.col("description")),
        )
    )
    return pairs.filter(ceiling >= _d(SUGGEST))


def evidence_pairs(receipts: DataFrame, cards: DataFrame, w: Weights = CARD_CENTRIC) -> DataFrame:
    """JOIN1/JOIN2: distinct receipt and card feature rows that can reach the threshold, scored.

    Columns: trip_id, kind, the features the kind uses (others null), ``first`` and
    ``first_group`` (earliest receipt and group of the feature rows), similarity, word_hit, score.
    """
    r_amount = ["currency", "share", "estimated_cad", "vendor"]
    c_amount = ["description", "purchase_abs", "purchase_currency", "cad_abs"]
    null_date = F.lit(None).cast("date")

    by_date = _no_amounts(
        multiplied(_near_days(_earliest(receipts, ["receipt_date", "vendor"]), w.day_band)).join(
            _first_group(cards, ["transaction_date", "description"]),
            ["trip_id", "transaction_date"],
        )
    ).withColumn("kind", F.lit("date"))

    by_amount = (
        multiplied(_receipt_amount_keys(_earliest(receipts, r_amount), w))
        .join(
            multiplied(_card_amount_keys(_first_group(cards, c_amount), w)),
            ["trip_id", "way", "bucket"],
        )
        .withColumns({"receipt_date": null_date, "transaction_date": null_date, "kind": F.lit("amount")})
    )

    by_both = (
        multiplied(_receipt_amount_keys(_earliest(receipts, ["receipt_date", *r_amount]), w))
        .filter(F.col("receipt_date").isNotNull())
        .withColumn("block", _day_block(F.col("receipt_date"), w.day_band))
        .join(
            multiplied(_card_blocks(_card_amount_keys(_first_group(cards, CARD_FEATURES), w), w.day_band)),
            ["trip_id", "way", "bucket", "block"],
        )
        .filter(days_apart(F.col("receipt_date"), F.col("transaction_date")) <= w.day_band)
        .withColumn("kind", F.lit("both"))
    )

    by_word = _no_amounts(
        multiplied(_vendor_words(_earliest(receipts, ["vendor"])))
        .join(
            multiplied(_description_grams(_first_group(cards, ["description"]))), ["trip_id", "gram"]
        )
        .withColumns({"receipt_date": null_date, "transaction_date": null_date, "kind": F.lit("word")})
    )

    cols = [
        "kind", "trip_id", "first", "first_group", "vendor", "receipt_date", "currency", "share", "estimated_cad",
        "transaction_date", "description", "purchase_abs", "purchase_currency", "cad_abs",
    ]
    points, _ = amount_points(w)
    with_amount = by_amount.select(cols).unionByName(by_both.select(cols)).filter(points > 0)
    pairs = by_date.select(cols).unionByName(by_word.select(cols)).unionByName(with_amount)
    # A pair may meet by more than one way or letter group; the aggregates that follow absorb repeats.
    return score_pairs(_reachable(pairs, w), w).filter(F.col("score") >= _d(SUGGEST))


# Features each kind of evidence uses: (receipt side, card side)
KIND_FEATURES = {
    "date": (["receipt_date", "vendor"], ["transaction_date", "description"]),
    "amount": (
        ["currency", "share", "estimated_cad", "vendor"],
        ["description", "purchase_abs", "purchase_currency", "cad_abs"],
    ),
    "both": (["receipt_date", "currency", "share", "estimated_cad", "vendor"], CARD_FEATURES),
    "word": (["vendor"], ["description"]),
}


def _equal(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def best_match(receipts: DataFrame, groups: DataFrame, w: Weights = CARD_CENTRIC) -> DataFrame:
    """RNK1: best receipt of each eligible group, ties to the earliest receipt; score >= .35.

    Per kind the best pair of a card feature row is a partial aggregate; the three coarse kinds
    attach to the cards by their own key, so no candidate list per group exists anywhere.
    Trips are matched in slices, so that the disk holds the evidence of one slice at a time.
    """
    return by_slices(lambda r, g: _best_match(r, g, w), ["trip_id"], receipts, groups)


def _best_match(receipts: DataFrame, groups: DataFrame, w: Weights) -> DataFrame:
    cards = card_rows(groups)
    pairs = evidence_pairs(receipts, cards, w)
    order = F.struct(
        (-F.col("score")).alias("neg"), F.col("first.file_key").alias("file_key"), F.col("first.source_file").alias("source_file")
    )
    # written once: a filter by kind does not pass the similarity, so each kind would score the pairs of all four
    best = materialize(
        pairs.groupBy("kind", "trip_id", *CARD_FEATURES)
        .agg(F.min_by(F.struct("score", "similarity", "first"), order).alias("b"))
    )
    distinct_cards = cards.select("trip_id", "card_key", *CARD_FEATURES).distinct()
    found = None
    for kind, (_, keys) in KIND_FEATURES.items():
        part = best.filter(F.col("kind") == kind).select("trip_id", *keys, "b").alias("p")
        c = distinct_cards.alias("c")
        cond = _equal("c", "p", ["trip_id", *keys])
        hit = c.join(grown(part), cond).select("c.trip_id", "c.card_key", "p.b")
        found = hit if found is None else found.unionByName(hit)
    top = found.groupBy("trip_id", "card_key").agg(
        F.min_by(
            F.col("b"),
            F.struct((-F.col("b.score")).alias("n"), F.col("b.first.file_key").alias("k"), F.col("b.first.source_file").alias("f")),
        ).alias("b")
    )
    return cards.join(grown(top), ["trip_id", "card_key"]).select(
        "trip_id",
        "group_id",
        F.col("b.first.source_file").alias("source_file"),
        F.col("b.score").alias("score"),
        F.col("b.similarity").alias("similarity"),
        *CARD_FEATURES,
        "clean_legs",
    )


# ------------------------------------------------------------------ reasons and assignment


def review_reason(gap: Column, same_day: Column, similarity: Column) -> Column:
    """RNK3."""
    pct = gap.cast("string")
    return (
        F.when(gap.isNull(), F.lit(""))
        .when(
            F.coalesce(same_day, F.lit(False)) & (similarity >= 0.35),
            F.concat(
                F.lit("Same merchant and date; receipt is "), pct, F.lit("% below the card total, possibly tax or tip.")
            ),
        )
        .otherwise(F.concat(F.lit("Receipt is "), pct, F.lit("% below the card total; review tax or tip.")))
    )


def auto_assign(best: DataFrame, receipts: DataFrame) -> DataFrame:
    """RNK2 + RNK3: reason from the matched receipt, then auto or suggested."""
    joined = best.join(
        grown(receipts.select("trip_id", "source_file", "receipt_date", "currency", "share")),
        ["trip_id", "source_file"],
    )
    reason = review_reason(
        card_gap_percent(F.col("share"), card_side()),
        F.col("receipt_date") == F.col("transaction_date"),
        F.col("similarity"),
    )
    out = joined.withColumn("review_reason", reason)
    auto = (F.col("score") >= _d(AUTO)) & (F.col("review_reason") == "") & F.col("clean_legs")
    return out.select(
        "trip_id",
        "group_id",
        F.when(auto, F.col("source_file")).alias("matched_file"),
        F.col("source_file").alias("suggested_file"),
        F.when(auto, F.lit("auto")).otherwise(F.lit("suggested")).alias("match_status"),
        F.round("score", 3).cast("decimal(6,3)").alias("match_confidence"),
        "review_reason",
    )


def match_groups(receipts: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with their automatic match columns (unmatched and audit groups included)."""
    matches = auto_assign(best_match(receipts, groups), receipts)
    return (
        groups.join(grown(matches), ["trip_id", "group_id"], "left")
        .withColumn(
            "match_status",
            F.coalesce(
                "match_status",
                F.when(F.col("match_eligible"), F.lit("unmatched")).otherwise(F.lit("audit")),
            ),
        )
        .withColumn("match_confidence", F.coalesce("match_confidence", F.lit(0).cast("decimal(6,3)")))
        .withColumn("review_reason", F.coalesce("review_reason", F.lit("")))
    )


# ------------------------------------------------------------------ receipt-centric suggestions


def suggestions(receipts: DataFrame, matched: DataFrame, top: int = 12, left_out: DataFrame | None = None) -> DataFrame:
    """RNK4: per receipt the current, suggested and likely card groups, best ``top`` (part of the rule).

    left_out: (trip_id, group_id) of ignored and allocated groups, which are never suggested.

    Distinct receipt features meet distinct card features; each receipt feature row keeps its best
    ``top`` card feature rows per kind of evidence, and each of those its first ``top`` groups.
    Every group left out has ``top`` better ones, so the final list is exact, and what reaches a
    receipt is bounded by a constant. Rank limits run before the shuffle of their window too. Trips go in slices (by_slices).
    """
    more = [] if left_out is None else [left_out]
    return by_slices(lambda r, m, *out: _suggestions(r, m, top, *out), ["trip_id"], receipts, matched, *more)


def _suggestions(receipts: DataFrame, matched: DataFrame, top: int, left_out: DataFrame | None = None) -> DataFrame:
    w = RECEIPT_CENTRIC
    if left_out is not None:
        matched = matched.join(left_out.select("trip_id", "group_id").distinct(), ["trip_id", "group_id"], "left_anti")
    cards = card_rows(matched)
    pairs = evidence_pairs(receipts, cards, w).withColumn("score", F.round("score", 3))
    # written once for the four kinds, with one row for each pair of features however often it meets
    features = dict.fromkeys(k for keys in KIND_FEATURES.values() for side in keys for k in side)
    met = materialize(
        pairs.groupBy("kind", "trip_id", *features).agg(F.max("score").alias("score"), F.min("first_group").alias("first_group"))
    )
    status = matched.select("trip_id", "group_id", "matched_file", "suggested_file")
    wanted = None
    for kind, (r_keys, c_keys) in KIND_FEATURES.items():
        best = Window.partitionBy("trip_id", *r_keys).orderBy(F.col("score").desc(), "first_group")
        found = met.filter(F.col("kind") == kind).select("trip_id", *r_keys, *c_keys, "score", "first_group")
        kept = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= top).alias("p")
        early = Window.partitionBy("trip_id", *c_keys).orderBy("group_id")
        c = cards.withColumn("_g", F.row_number().over(early)).filter(F.col("_g") <= top).alias("c")
        part = (
            receipts.alias("r")
            .join(grown(kept), _equal("r", "p", ["trip_id", *r_keys]))
            .select("r.source_file", "p.trip_id", *[f"p.{k}" for k in c_keys])
            .alias("q")
            .join(grown(c), _equal("q", "c", ["trip_id", *c_keys]))
            .select("q.trip_id", "q.source_file", "c.group_id")
        )
        wanted = part if wanted is None else wanted.unionByName(part)
    eligible = status.join(grown(cards.select("trip_id", "group_id")), ["trip_id", "group_id"])
    named = eligible.select("trip_id", F.col("matched_file").alias("source_file"), "group_id").unionByName(
        eligible.select("trip_id", F.col("suggested_file").alias("source_file"), "group_id")
    ).filter("source_file is not null")
    pairs = (
        wanted.unionByName(named)
        .distinct()
        .join(grown(receipts), ["trip_id", "source_file"])
        .join(grown(cards.drop("card_key", "clean_legs")), ["trip_id", "group_id"])
        .join(grown(status), ["trip_id", "group_id"])
    )
    scored = score_pairs(pairs, w)
    gap = card_gap_percent(F.col("share"), card_side())
    same_day = F.coalesce(F.col("receipt_date") == F.col("transaction_date"), F.lit(False))
    out = scored.select(
        "trip_id",
        "source_file",
        "group_id",
        F.round("score", 3).cast("decimal(6,3)").alias("score"),
        (F.col("score") >= _d(SUGGEST)).alias("likely"),
        F.coalesce(F.col("matched_file") == F.col("source_file"), F.lit(False)).alias("current"),
        F.coalesce(F.col("suggested_file") == F.col("source_file"), F.lit(False)).alias("suggested"),
        F.coalesce(F.col("matched_file") != F.col("source_file"), F.lit(False)).alias("matched_elsewhere"),
        F.when(gap.isNotNull(), review_reason(gap, same_day, F.col("similarity")))
        .when(same_day, F.lit("Same transaction date; amount and merchant also influence this ranking."))
        .otherwise(F.lit(""))
        .alias("reason"),
    )
    order = Window.partitionBy("trip_id", "source_file").orderBy(
        F.col("current").desc(), F.col("suggested").desc(), F.col("likely").desc(), F.col("score").desc(), "group_id"
    )
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


# ------------------------------------------------------------------ incremental scope


def incremental_scope(
    previous: DataFrame,
    receipts: DataFrame,
    manual_matches: DataFrame,
    allocations: DataFrame,
    dispositions: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """INC1: (groups to match again, receipts still free) after protecting settled ones."""
    files = receipts.select("trip_id", "source_file").distinct()
    matched = (
        previous.select("trip_id", "group_id", F.col("matched_file").alias("source_file"))
        .filter("source_file is not null")
        .join(files, ["trip_id", "source_file"], "left_semi")
    )
    split = allocations.select("trip_id", "group_id", "source_file")
    manual = manual_matches.select("trip_id", "group_id", "source_file")
    ignored = dispositions.filter("action = 'ignore'").select("trip_id", "group_id")
    protected = (
        matched.select("trip_id", "group_id")
        .unionByName(split.select("trip_id", "group_id"))
        .unionByName(manual.select("trip_id", "group_id"))
        .unionByName(ignored)
        .distinct()
    )
    taken = (
        matched.select("trip_id", "source_file")
        .unionByName(split.select("trip_id", "source_file"))
        .unionByName(manual.select("trip_id", "source_file"))
        .filter("source_file is not null")
        .distinct()
    )
    return (
        previous.join(protected, ["trip_id", "group_id"], "left_anti"),
        receipts.join(taken, ["trip_id", "source_file"], "left_anti"),
    )
