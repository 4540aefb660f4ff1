"""Receipt text to fields and lines (TXT1-TXT14, TXT17, TXT19).

A receipt's text is one row. Its lines are an array inside that row and every rule is an array
expression over it, so the whole extraction is a map-only stage without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.aggs import append_note
from tripledger.functions.cleaners import MONTHS, bind, contains_any, finds, is_ascii, title_words
from tripledger.functions.money_text import ADDITIVE, CURRENCIES, OPEN, line_info, strip_tokens
from tripledger.operators.lines import TAX_LABELS, tax_line_type

AMOUNT = "decimal(18,2)"
MON = "|".join(MONTHS)
CODES = "|".join(CURRENCIES)
# Reasons of the alcohol rules that say nothing about the line
NO_EVIDENCE = ["empty description", "no alcohol evidence"]


def text_lines(raw: Column) -> Column:
    """TXT1: trimmed non-blank lines in order."""
    return F.filter(F.transform(F.split(raw, r"\R|\u000B|\u000C|\u0085"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def with_lines(receipts: DataFrame) -> DataFrame:
    """Add ``lines`` and ``info`` (text, marked text, amounts) arrays; the base of every rule."""
    return receipts.withColumn("lines", text_lines(F.coalesce("raw_text", F.lit("")))).withColumn(
        "info", F.transform("lines", line_info)
    )


def candidate_lines(info: Column) -> Column:
    """Lines, each stand-alone amount also joined with the amount-free label line before it."""

    def alone(x: Column) -> Column:
        return (F.size(x["money"]) == 1) & (F.trim(strip_tokens(x["marked"])) == "")

    def expand(x: Column, i: Column) -> Column:
        before = F.get(info, i - 1)
        joined = F.concat(before["text"], F.lit(" "), x["text"])
        return F.when(
            (i > 0) & alone(x) & (F.size(before["money"]) == 0), F.array(x, line_info(joined))
        ).otherwise(F.array(x))

    return F.flatten(F.transform(info, expand))


# ------------------------------------------------------------------ dates


def _dates(text: Column, pattern: str, build, fmt: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if pattern.startswith("(?iU)"):  # see finds
        hits = F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(pattern.replace("(?iU)", "(?i)", 1)), F.lit(0))).otherwise(hits)
    return F.array_compact(F.transform(hits, lambda m: F.try_to_date(build(m, pattern), fmt)))


def _g(m: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(m, pattern, i)


def _ymd(m: Column, p: str) -> Column:
    return F.concat_ws("-", _g(m, p, 1), _g(m, p, 2), _g(m, p, 3))


def find_date(text: Column) -> Column:
    """First valid date of the first of six notations that has one."""
    iso = r"(?<!\d)(20\d{2})[-/](\d{1,2})[-/](\d{1,2})(?!\d)"
    dmy = r"(?<!\d)(\d{1,2})[-/](\d{1,2})[-/](20\d{2})(?!\d)"
    day_mon = rf"(?iU)\b(\d{{1,2}})\s+({MON})[a-z]*\.?,?\s+(20\d{{2}})\b"
    mon_day = rf"(?iU)\b({MON})[a-z]*\.?\s+(\d{{1,2}}),?\s+(20\d{{2}})\b"
    packed = rf"(?iU)\b(\d{{1,2}})({MON})[a-z]*\.?(\d{{2}}|20\d{{2}})\b"
    compact = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
    month = lambda m, p, i: F.initcap(F.lower(F.left(_g(m, p, i), F.lit(3))))
    packed_year = lambda m, p: F.when(F.length(_g(m, p, 3)) == 4, _g(m, p, 3)).otherwise(
        F.concat(F.lit("20"), _g(m, p, 3))
    )
    not_future = F.year(F.current_date()) + 1
    found = [
        _dates(text, iso, _ymd, "yyyy-M-d"),
        _dates(text, dmy, lambda m, p: F.concat_ws("-", _g(m, p, 3), _g(m, p, 2), _g(m, p, 1)), "yyyy-M-d"),
        _dates(text, day_mon, lambda m, p: F.concat_ws("-", _g(m, p, 1), month(m, p, 2), _g(m, p, 3)), "d-MMM-yyyy"),
        _dates(text, mon_day, lambda m, p: F.concat_ws("-", _g(m, p, 2), month(m, p, 1), _g(m, p, 3)), "d-MMM-yyyy"),
        _dates(
            text,
            packed,
            lambda m, p: F.when(
                packed_year(m, p).cast("int") <= not_future,
                F.concat_ws("-", _g(m, p, 1), month(m, p, 2), packed_year(m, p)),
            ),
            "d-MMM-yyyy",
        ),
        _dates(text, compact, _ymd, "yyyy-MM-dd"),
    ]
    return F.coalesce(*[F.get(f, F.lit(0)) for f in found])


LABELLED = (
    r"(?iU)\b(?:invoice|issue|issued|booking|purchase|transaction)\s+date\b|\bIssuing Airline and date\b"
)


def find_invoice_date(lines: Column) -> Column:
    """Date on a labelled line or one of the three lines after it."""

    def near(line: Column, i: Column) -> Column:
        window = F.slice(lines, i + 1, F.lit(4))
        dates = F.array_compact(F.transform(window, find_date))
        return F.when(finds(line, LABELLED), F.get(dates, F.lit(0)))

    labelled = F.lower(F.array_join(lines, "\n")).contains("date")  # as every label does
    return F.when(labelled, F.get(F.array_compact(F.transform(lines, near)), F.lit(0)))


def find_filename_date(name: Column) -> Column:
    """Only date the file name can mean; null when it allows two. Every notation has a year 20.. or a month behind a digit."""
    base = F.regexp_replace(name, r"^.*/", "")
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    first = r"(?<!\d)(20\d{2})[._\-\s]?(\d{1,2})[._\-\s]?(\d{1,2})(?!\d)"
    last = r"(?<!\d)(\d{1,2})[._\-\s](\d{1,2})[._\-\s](20\d{2})(?!\d)"
    last_packed = r"(?<!\d)(\d{2})(\d{2})(20\d{2})(?!\d)"
    dmy = lambda m, p: F.concat_ws("-", _g(m, p, 3), _g(m, p, 2), _g(m, p, 1))
    mdy = lambda m, p: F.concat_ws("-", _g(m, p, 3), _g(m, p, 1), _g(m, p, 2))
    every = F.concat(
        _dates(stem, first, _ymd, "yyyy-M-d"),
        *[_dates(stem, p, order, "yyyy-M-d") for p in (last, last_packed) for order in (dmy, mdy)],
        F.array_compact(F.array(find_date(F.regexp_replace(stem, "_+", " ")))),
    )
    only = bind(F.array_distinct(every), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))
    return F.when(finds(name, rf"(?iU)20\d{{2}}|\d(?:{MON})"), only)


# ------------------------------------------------------------------ supplier

# Words of lines that name no supplier
NOT_A_SUPPLIER = ["receipt", "tax invoice", "invoice", "abn", "gst", "date", "amount", "total", "gmail", "reply-to", "to:"]


def find_supplier(lines: Column, name: Column, ignore: Sequence[str] = ()) -> Column:
    """TXT5. ignore: further words (of the payer's own letterhead, for one) that no supplier line holds, in lower case."""
    edge = r"^[ :\-]+|[ :\-]+$"

    def restaurant(line: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), edge, "")
        t = F.regexp_replace(t, r"(?i)^served by\s+[A-Za-z]+\s+", "")
        t = F.trim(F.regexp_replace(t, "^.*«", ""))
        t = F.regexp_replace(F.regexp_replace(t, r"(?U)\b\d+\b.*$", ""), edge, "")
        hit = F.regexp_extract(t, r"(?i)([A-Za-z][A-Za-z &'*-]*\bRestaurant\b)", 1)
        titled = F.regexp_replace(title_words(hit), r"(?<=^| )And(?= |$)", "and")
        titled = F.regexp_replace(F.regexp_replace(titled, r"(?<=^| )Of(?= |$)", "of"), r"(?<=^| )The(?= |$)", "the")
        return F.when(finds(line, r"(?iU)\brestaurant\b") & (hit != ""), F.left(titled, F.lit(80)))

    ignored = "(?i)" + "|".join([*NOT_A_SUPPLIER, *(re.escape(w) for w in ignore)])

    def plain(line: Column) -> Column:
        tidy = F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), edge, "")
        return bind(tidy, lambda t: F.when((F.length(t) >= 3) & ~t.rlike(ignored) & ~t.rlike(r"\d"), F.left(t, F.lit(80))))

    base = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    from_name = F.left(F.trim(F.regexp_replace(base, "[_-]+", " ")), F.lit(80))
    head = lambda n, rule: F.get(F.array_compact(F.transform(F.slice(lines, 1, n), rule)), F.lit(0))
    # the first line mostly is one: the others are looked at where it is not
    return F.coalesce(head(20, restaurant), head(1, plain), head(14, plain), F.nullif(from_name, F.lit("")), F.lit("Unknown supplier"))


# ------------------------------------------------------------------ total and currency


# Of a line that a rule's pattern finds, each has at least one of the rule's words
CATEGORY_WORDS = ["food", "f0od", "fcod", "fc0d", "bev", "drink", "age", "misc"]
PAID_WORDS = ["paid", "fare"]
CARD_WORDS = ["american expr", "amex", "visa", "card"]
OTHER_WORDS = ["check", "table", "account", "phone", "street", "postcode", "staff", "cover", "abn", "agn", "invoice no", "booking reference"]
FARE_WORDS = ["fare", "roe", "nuc"]
METADATA_WORDS = [
    "abn", "agn", "acn", "merchant", "phone", "mobile", "ticket", "iata", "booking", "reference", "invoice no", "account", "table", "check", "cover",
]


def infer_currency(text: Column) -> Column:
    """TXT7: code in the text, Australian markers, then $ as AUD."""
    upper = F.upper(text)
    coded = F.coalesce(*[F.when(upper.contains(c), F.lit(c)) for c in CURRENCIES])
    return F.coalesce(
        coded,
        F.when(contains_any(upper, ["AUSTRALIAN DOLLAR", "AUSTRALIA", "MELBOURNE", " VIC"]), F.lit("AUD")),
        F.when(text.contains("$"), F.lit("AUD")),
    )


def normalize_currency(token: Column, inferred: Column) -> Column:
    def code(t: Column) -> Column:
        return (
            F.when(t.isin("AU", "AUD"), F.lit("AUD"))
            .when(t.isin("CA", "CAD"), F.lit("CAD"))
            .when(t.isin(*CURRENCIES), t)
            .otherwise(inferred)
        )

    return F.when(token.isNull(), inferred).otherwise(bind(F.translate(F.upper(token), "$", ""), code))


def is_category_total(line: Column) -> Column:
    return finds(
        line, r"(?iU)\b(?:food|f[o0]od|fc[o0]d|beverage|bev|drink|age|misc(?:ellaneous)?)\b.*\btotal\b"
    ) | finds(line, r"(?iU)^\s*(?:food sales|beverage)\b")


def is_metadata(line: Column, may_name: Column | None = None) -> Column:
    """may_name: false where it is known that the line holds none of METADATA_WORDS."""
    words = (
        r"(?iU)\b(?:abn|agn|acn|merchant|phone|telephone|mobile|ticket|iata|booking|reference|invoice no|"
        r"account|table|check|covers?)\b"
    )
    named = finds(line, words) if may_name is None else may_name & finds(line, words)
    return named | (line.rlike(r"(?:\d[\s-]*){8,}") & ~finds(line, r"(?iU)\btotal\b"))


def is_tax_summary(line: Column) -> Column:
    return (
        finds(line, r"(?iU)\btotal\s+(?:ex|inc|incl|including|excluding)\s+tax\b")
        | finds(line, r"(?iU)\btotal\s+(?:includes?|included)\s+gst\b")
        | finds(line, r"(?iU)^\s*-?\s*(?:gst|tax free|tax exempt)\b")
        | finds(line, r"(?iU)^\s*-?\s*(?:sales tax|tax|vat)\s+\$?\s*\d")
    )


def _subtotal_plus_extras(info: Column, inferred: Column) -> Column:
    """struct(amount, currency) of the last subtotal line plus the payable extras after it."""
    hits = F.array_compact(
        F.transform(
            info,
            lambda x, i: F.when(
                (F.size(x["money"]) > 0) & finds(x["text"], r"(?iU)\bsubtotal\b"),
                F.struct(i.alias("i"), F.element_at(x["money"], -1).alias("m")),
            ),
        )
    )
    last = F.get(hits, F.size(hits) - 1)
    extra = lambda x: F.when(
        finds(x["text"], r"(?iU)\b(?:surcharge|service\s+(?:fee|charge)|gratuity|tip)\b")
        & ~is_tax_summary(x["text"])
        & (F.size(x["money"]) > 0),
        F.element_at(x["money"], -1)["amount"],
    ).otherwise(F.lit(0).cast(AMOUNT))
    added = F.aggregate(
        F.slice(info, last["i"] + 2, F.lit(7)), F.lit(0).cast(AMOUNT), lambda acc, x: (acc + extra(x)).cast(AMOUNT)
    )
    return F.when(
        last.isNotNull(),
        F.struct(
            (last["m"]["amount"] + added).cast(AMOUNT).alias("amount"),
            F.coalesce(normalize_currency(last["m"]["currency"], inferred), inferred).alias("currency"),
        ),
    )


def find_total(info: Column, inferred: Column) -> Column:
    """TXT6: struct(amount, currency). Highest weight, then amount, then earliest line."""
    text = F.array_join(F.transform(info, lambda x: x["text"]), "\n")

    def gates(text: Column) -> Column:
        """Which rules may find something: one whose words the whole text lacks is not tried line by line."""
        low = F.lower(text)
        rules = {"category": CATEGORY_WORDS, "paid": PAID_WORDS, "card": CARD_WORDS, "other": OTHER_WORDS, "fare": FARE_WORDS, "metadata": METADATA_WORDS}
        return F.struct(*[(~is_ascii(text) | contains_any(low, words)).alias(rule) for rule, words in rules.items()])

    return bind(bind(text, gates), lambda may: _total(info, inferred, may))


def _total(info: Column, inferred: Column, may: Column) -> Column:
    def kinds(line: Column) -> Column:
        return F.struct(
            (may["category"] & is_category_total(line)).alias("category"),
            finds(line, r"(?iU)\b(grand total|total amount|amount paid|balance due|total)\b").alias("total"),
        )

    def facts(line: Column, kind: Column) -> Column:
        category, strong = kind["category"], kind["total"] & ~kind["category"]
        weight = (
            F.when(strong, 50)
            .when(category, 8)
            .when(may["paid"] & finds(line, r"(?iU)\b(paid|fare)\b"), 10)
            .when(may["card"] & finds(line, r"(?iU)\b(?:american expr|amex|visa|mastercard|card)\b"), 12)
            .otherwise(0)
            - F.when(
                may["other"]
                & finds(
                    line,
                    r"(?iU)\b(check|echeck|table|account|phone|telephone|street|postcode|staff|covers|cover|abn|agn|"
                    r"invoice no|booking reference)\b",
                ),
                30,
            ).otherwise(0)
            - F.when(may["fare"] & finds(line, r"(?iU)\b(fare calculation|roe|nuc)\b"), 20).otherwise(0)
            - F.when(
                finds(line, r"(?iU)\b(subtotal|tax|gst|tip|gratuity|discount|change|surcharge|service fee)\b"), 5
            ).otherwise(0)
        )
        return F.struct(
            weight.alias("weight"),
            strong.alias("strong"),
            (line.contains("$") | finds(line, rf"(?iU)\b({CODES})\b")).alias("marker"),
        )

    def candidates(x: Column, i: Column) -> Column:
        def one(m: Column, f: Column) -> Column:
            wanted = (m["amount"] > 0) & ((f["weight"] > 0) | f["marker"] | m["currency"].isNotNull())
            return F.when(wanted, bind(normalize_currency(m["currency"], inferred), lambda cur: priced_in(cur, m, f)))

        def priced_in(cur: Column, m: Column, f: Column) -> Column:
            dropped = F.coalesce((cur == "AUD") & (m["amount"] > 5000) & ~f["strong"], F.lit(False))
            return F.when(
                ~dropped,
                F.struct(
                    f["weight"].alias("weight"), m["amount"].alias("amount"), (-i).alias("place"),
                    F.coalesce(cur, F.lit("")).alias("currency"),
                ),
            )

        def priced(kind: Column) -> Column:
            counts = (kind["total"] & ~kind["category"]) | ~is_metadata(x["text"], may["metadata"])
            return F.when(counts, bind(facts(x["text"], kind), lambda f: F.array_compact(F.transform(x["money"], lambda m: one(m, f)))))

        return F.when(F.size(x["money"]) > 0, bind(kinds(x["text"]), priced))

    fallback = _subtotal_plus_extras(info, inferred)

    def choice(best: Column) -> Column:
        chosen = F.struct(
            best["amount"].alias("amount"), F.coalesce(F.nullif(best["currency"], F.lit("")), inferred).alias("currency")
        )
        return F.when(best.isNotNull() & (best["weight"] >= 50), chosen).otherwise(
            F.coalesce(fallback, F.when(best.isNotNull(), chosen))
        )

    return bind(F.array_max(F.flatten(F.array_compact(F.transform(info, candidates)))), choice)


# ------------------------------------------------------------------ classification


def classify_expense(text: Column, supplier: Column, name: Column) -> Column:
    """TXT9: ordered keyword rules."""
    blob = F.lower(F.concat_ws(" ", text, supplier, name))
    has = lambda *words: contains_any(blob, list(words))
    return (
        F.when(has("airways", "airline", "flight", "e-ticket", "itinerary", "airport", "garuda", "thai airways"), "flight")
        .when(has("hotel", "room", "arrival", "departure", "meridien"), "hotel")
        .when(has("uber") & has("restaurant", "uber eats"), "meal-dinner")
        .when(has("uber", "taxi", "ride"), "transport")
        .when(
            has("farmers", "nigel", "reine", "la rue", "gabriel", "intermission"),
            F.when(has("breakfast", "cappuccino", "benedict", "banana bread", "espresso"), "meal-breakfast").otherwise("meal-dinner"),
        )
        .when(has("breakfast"), "meal-breakfast")
        .when(has("lunch"), "meal-lunch")
        .when(has("dinner", "restaurant"), "meal-dinner")
        .when(
            has(
                "espresso", "cafe", "bbq", "bar", "kitchen", "burger", "beer", "restaurant", "hanks", "eat-in", "eatin",
                "dine in", "dining", "cappuccino", "benedict",
            ),
            "meal",
        )
        .otherwise("other")
    )


def simple_type(kind: Column) -> Column:
    return F.when(kind.startswith("meal"), F.lit("meal")).when(
        kind.isin("flight", "hotel", "transport", "other"), kind
    ).otherwise(F.lit("other"))


# ------------------------------------------------------------------ tax, registration, location


def _labelled_amount(info: Column, label: str, skip: str | None) -> Column:
    """Last amount on the first labelled line that has one, or the stand-alone amount below it."""

    def value(x: Column, i: Column) -> Column:
        own = F.filter(x["money"], lambda m: F.abs(m["amount"]) < 100000)
        below = F.get(info, i + 1)
        alone = (F.size(below["money"]) == 1) & (F.trim(strip_tokens(below["marked"])) == "")
        under = F.when(alone & (F.abs(F.get(below["money"], F.lit(0))["amount"]) < 100000), F.get(below["money"], F.lit(0))["amount"])
        labelled = finds(x["text"], label)
        if skip:
            labelled = labelled & ~finds(x["text"], skip)
        return F.when(labelled, F.when(F.size(own) > 0, F.element_at(own, -1)["amount"]).otherwise(under))

    return F.get(F.array_compact(F.transform(info, value)), F.lit(0))


def find_taxes(info: Column) -> dict[str, Column]:
    """TXT10: gst_hst, qst and subtotal."""
    reg = r"(?iU)\b(?:no|number|registration|reg)\b"
    return {
        "gst_hst": _labelled_amount(info, r"(?iU)\b(?:GST|HST|TPS|TVH)\b", reg),
        "qst": _labelled_amount(info, r"(?iU)\b(?:QST|TVQ)\b", reg),
        "subtotal": _labelled_amount(info, r"(?iU)\bsub\s*-?\s*total\b", None),
    }


def registration_numbers(text: Column) -> dict[str, Column]:
    """TXT11."""
    compact = F.regexp_replace(F.upper(text), "[ .-]", "")
    return {
        "gst_hst_number": F.regexp_extract(compact, r"(?<!\d)(\d{9}RT\d{4})(?!\d)", 1),
        "qst_number": F.regexp_extract(compact, r"(?<!\d)(\d{10}TQ\d{4})(?!\d)", 1),
    }


# Fixed values
PROVINCES = {
    "QC": r"(?U)\b(?i:québec|quebec|montreal|montréal)\b|\bQC\b",
    "ON": r"(?U)\b(?i:ontario|toronto|ottawa)\b|\bON\b",
    "BC": r"(?U)\b(?i:british columbia|vancouver|victoria)\b|\bBC\b",
    "AB": r"(?U)\b(?i:alberta|calgary|edmonton)\b|\bAB\b",
}
CANADA = r"(?iU)\b(?:canada|québec|quebec|montreal|montréal|toronto|ontario|vancouver|calgary)\b"
CURRENCY_COUNTRY = {
    "AUD": "Australia", "USD": "United States", "GBP": "United Kingdom", "IDR": "Indonesia", "VND": "Vietnam",
    "QAR": "Qatar", "HKD": "Hong Kong", "CHF": "Switzerland",
}


def infer_location(text: Column, currency: Column) -> dict[str, Column]:
    """TXT12."""
    from tripledger.functions.cleaners import literal_map

    province = F.coalesce(*[F.when(finds(text, p), F.lit(c)) for c, p in PROVINCES.items()], F.lit(""))
    canada = (province != "") | F.coalesce(currency == "CAD", F.lit(False)) | finds(text, CANADA)
    return {
        "province": F.when(canada, province).otherwise(F.lit("")),
        "country": F.when(canada, F.lit("Canada")).otherwise(
            F.coalesce(literal_map(CURRENCY_COUNTRY)[F.coalesce(currency, F.lit(""))], F.lit(""))
        ),
    }


# ------------------------------------------------------------------ scores


def confidence_score(text: Column, day: Column, vendor: Column, amount: Column) -> Column:
    """TXT13."""
    d = lambda v: F.lit(v).cast("decimal(4,2)")
    score = (
        F.when(F.trim(text) != "", d("0.15")).otherwise(d("0"))
        + F.when(day.isNotNull(), d("0.25")).otherwise(d("0"))
        + F.when((vendor != "") & (vendor != "Unknown supplier"), d("0.20")).otherwise(d("0"))
        + F.when(amount.isNotNull(), d("0.25")).otherwise(d("0"))
        + F.when(F.length(text) > 300, d("0.10")).otherwise(d("0"))
    )
    return F.least(score, d("0.95")).cast("decimal(4,2)")


def quality_score(note: Column) -> Column:
    """TXT14: completeness of one extraction; ``note`` is its LIN4 note."""
    d = lambda v: F.lit(v).cast("decimal(4,2)")
    vendor, kind = F.col("vendor"), F.coalesce("expense_type", F.lit(""))
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), d(v)).otherwise(d("0"))
    lines = F.when(
        kind.startswith("meal"),
        F.when(note == "", d("2")).when(~note.contains("No reliable") & ~note.contains("Missing"), d("0.75")).otherwise(d("0")),
    ).otherwise(d("0"))
    return (
        yes(F.col("receipt_date").isNotNull(), "2")
        + yes((vendor != "") & (vendor != "Unknown supplier"), "2")
        + yes(F.col("amount").isNotNull(), "2")
        + yes(F.col("currency") != "", "1")
        + lines
        + F.least(F.col("confidence").cast("decimal(4,2)"), d("1"))
    ).cast("decimal(6,2)")


def best_extraction(versions: DataFrame) -> DataFrame:
    """TXT14: highest ``quality`` per receipt, ties to the lowest ``version``; a map-side combined aggregate."""
    rest = [c for c in versions.columns if c not in ("trip_id", "source_file")]
    best = versions.groupBy("trip_id", "source_file").agg(
        F.min_by(F.struct(*rest), F.struct((-F.col("quality")).alias("q"), F.col("version"))).alias("_b")
    )
    return best.select("trip_id", "source_file", "_b.*")


# ------------------------------------------------------------------ whole receipt


def extract_receipts(receipts: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """TXT3-TXT13 over (trip_id, source_file, raw_text, method). ignore: words that no supplier line holds."""
    base = with_lines(receipts)
    text = F.coalesce("raw_text", F.lit(""))
    step = base.withColumns(
        {
            "document_date": F.coalesce(find_invoice_date(F.col("lines")), find_date(text)),
            "filename_date": find_filename_date(F.col("source_file")),
            "vendor": find_supplier(F.col("lines"), F.col("source_file"), ignore),
            "_inferred": infer_currency(text),
            **registration_numbers(text),
        }
    ).withColumns(
        {
            "_total": find_total(F.col("info"), F.col("_inferred")),
            **find_taxes(F.col("info")),
            "expense_type": classify_expense(text, F.col("vendor"), F.col("source_file")),
        }
    )
    out = step.withColumns(
        {
            "receipt_date": F.coalesce("document_date", "filename_date"),
            "amount": F.col("_total.amount"),
            "currency": F.col("_total.currency"),
        }
    )
    from_name = F.col("filename_date").isNotNull() & F.col("document_date").isNull()
    conflict = F.col("filename_date").isNotNull() & (F.col("document_date") != F.col("filename_date"))
    guessed = (
        F.coalesce(F.col("currency") == "AUD", F.lit(False))
        & text.contains("$")
        & ~finds(text, r"(?iU)\b(AUD|AUSTRALIAN|AUSTRALIA|MELBOURNE|VICTORIA|VIC)\b")
    )
    score = confidence_score(text, F.col("receipt_date"), F.col("vendor"), F.col("amount"))
    cap = lambda c, when, v: F.when(when, F.least(c, F.lit(v).cast("decimal(4,2)"))).otherwise(c)
    name_day = F.col("filename_date").cast("string")
    note = F.concat_ws(
        " ",
        F.when(
            from_name,
            F.concat(
                F.lit("Date "), name_day,
                F.lit(" inferred from the source filename because no date was found in the receipt content; review."),
            ),
        ).when(
            conflict,
            F.concat(
                F.lit("Source filename suggests date "), name_day, F.lit(", but receipt content shows "),
                F.col("document_date").cast("string"), F.lit("; kept the receipt date."),
            ),
        ),
        F.when(guessed, F.lit("Currency inferred as AUD from $; review if receipt is not Australian.")),
        F.when(F.col("method") == "empty", F.lit("No extractable text/OCR output; review manually.")),
    )
    subtotal = F.coalesce(
        F.col("subtotal"),
        F.when(
            F.col("gst_hst").isNotNull() | F.col("qst").isNotNull(),
            (F.col("amount") - F.coalesce("gst_hst", F.lit(0)) - F.coalesce("qst", F.lit(0))).cast(AMOUNT),
        ),
    )
    return out.withColumns(
        {
            "confidence": cap(cap(score, from_name, "0.70"), guessed, "0.68").cast("decimal(4,2)"),
            "review_note": note,
            "subtotal": subtotal,
            **infer_location(text, F.col("currency")),
        }
    ).drop("_total", "_inferred")


# ------------------------------------------------------------------ purchase lines

DISCOUNT = r"(?iU)\b(?:discount|promotion|promo|coupon|credit|rebate|remise|rabais)\b"
INCLUDED_TAX = r"(?iU)\b(?:includes?|included|incl\.?)\b"
SKIP = (
    r"(?iU)\b(total|subtotal|visa|mastercard|amex|american express|paid|payment|balance|change|covers|table|account|"
    r"check|abn|agn|address|phone|telephone|served by)\b"
)


def purchase_lines(extracted: DataFrame) -> DataFrame:
    """TXT8: purchasable lines of meal receipts, one row per line (alcohol added by the alcohol operator).

    Each line is judged inside its receipt: as columns, the rules make one method that is too long to be compiled.
    """
    meals = extracted.filter(F.col("expense_type").startswith("meal"))
    every = F.transform(candidate_lines(F.col("info")), lambda x, i: _purchase(x, i, F.col("amount")))
    return meals.select("trip_id", "source_file", F.inline(F.array_compact(every)))


def _purchase(x: Column, pos: Column, total: Column) -> Column:
    """The line (pos, description, amount, confidence, discount) that a candidate is; null if it is none."""
    line, money, marked = x["text"], x["money"], x["marked"]
    looks = (
        line.contains("$")
        | finds(line, rf"(?iU)\b({CODES})\b")
        | line.rlike(r"^\s*[A-Za-z][A-Za-z0-9 &'*/().,-]{2,}\s+\d+[,.]\d{2}\s*$")
        | line.rlike(r"(?i)^\s*\d+\s*[x«]\s+\D+.*\d+[,.]\d{2}\s*$")
    )
    plain = looks & ~finds(line, r"(?iU)^\s*(food sales|beverage|misc(?:ellaneous)?)\b") & ~is_tax_summary(line)
    # an extra counts unless it is included; any other line unless it is none to buy
    extra = ~finds(line, INCLUDED_TAX) | finds(line, r"(?iU)\b(?:surcharge|service|tip|gratuity)\b")
    bought = lambda additive: F.when(additive, extra).otherwise(~finds(line, SKIP) & ~is_metadata(line))

    def picked(additive: Column) -> Column:
        after_first = F.trim(F.element_at(F.split(marked, OPEN, 2), -1))
        trailing = strip_tokens(F.trim(F.regexp_replace(after_first, "^[^\u0002]*\u0002", "")))
        wordy = bind(trailing, lambda t: (F.length(t) > 25) & t.rlike(r"(?i)[a-z]{4,}.*[a-z]{4,}"))
        m = F.when(~additive & (F.size(money) > 1) & wordy, F.get(money, F.lit(0))).otherwise(F.get(money, F.size(money) - 1))
        return bind(F.struct(m.alias("m"), additive.alias("additive"), finds(line, DISCOUNT).alias("discount")), priced)

    def priced(p: Column) -> Column:
        amount, discount = p["m"]["amount"], p["discount"]
        limit = F.when(total.isNull(), F.lit(250)).otherwise(F.greatest(F.lit(250), total * F.lit("0.8").cast("decimal(2,1)")))
        fits = (
            (amount != 0)
            & ((amount > 0) | discount)
            & (discount | total.isNull() | (amount <= total))
            & (discount | p["additive"] | (amount <= limit))
        )
        token = F.concat(F.lit(OPEN), p["m"]["token"], F.lit("\u0002"))
        cut = F.call_function("locate", token, marked)
        sides = F.struct(
            F.trim(F.substring(marked, F.lit(1), cut - 1)).alias("before"),
            F.trim(F.substring(marked, cut + F.length(token), F.length(marked))).alias("after"),
        )
        return F.when(fits, bind(sides, lambda s: named(p, s)))

    def named(p: Column, sides: Column) -> Column:
        before, after = sides["before"], sides["after"]
        text = F.regexp_replace(strip_tokens(F.when(before != "", before).otherwise(after)), r"^[ .:\-\t]+|[ .:\-\t]+$", "")
        text = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)\s*$", ""), r"^[ .:\-\t]+|[ .:\-\t]+$", "")
        text = F.regexp_replace(text, r"(?U)\s+", " ")
        text = F.regexp_replace(F.regexp_replace(text, r"^[|!Il1x«\s@]+", ""), r"^[ .:\-\t]+|[ .:\-\t]+$", "")
        bracketed = before.endswith("(") & after.startswith(")")
        return F.when(~bracketed | p["additive"], bind(F.left(text, F.lit(120)), lambda d: row(p, d)))

    def row(p: Column, description: Column) -> Column:
        return F.when(
            F.length(F.regexp_replace(description, "[^A-Za-z]", "")) >= 3,
            F.struct(
                pos.cast("bigint").alias("pos"),
                description.alias("description"),
                p["m"]["amount"].alias("amount"),
                F.when(p["discount"], 0.85).when(p["additive"], 0.75).otherwise(0.6).alias("confidence"),
                p["discount"].alias("discount"),
            ),
        )

    judged = lambda additive: F.when(bought(additive), picked(additive))
    return F.when((F.size(money) > 0) & plain, bind(finds(line, ADDITIVE), judged))


def merge_external_receipts(local: DataFrame, external: DataFrame) -> DataFrame:
    """TXT19, fields: per receipt the external extraction where its TXT14 ``quality`` is at least the local one's, else the local one.

    Receipts of one side only keep that side. Both sides have the same columns; ``origin`` says which was taken.
    """
    both = external.withColumns({"version": F.lit(0), "origin": F.lit("external")}).unionByName(
        local.withColumns({"version": F.lit(1), "origin": F.lit("local")})
    )
    return best_extraction(both).drop("version")


def lines_reconcile(rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """(trip, file, fits, any): whether the lines of a receipt make up its total within .05.

    At least two lines with an amount count that are neither tax nor made up by a rule; a tax line is replaced by the tax
    field of its kind. No lines never fit.
    """
    key = ["trip_id", "source_file"]
    amount = F.coalesce("amount", F.lit(0).cast(AMOUNT))
    kind = tax_line_type(F.col("description"))
    if "line_type" in rows.columns:
        kind = F.coalesce(F.when(F.col("line_type").isin(list(TAX_LABELS)), F.col("line_type")), kind)
    made_up = F.coalesce("synthetic", F.lit(False)) if "synthetic" in rows.columns else F.lit(False)
    tax = kind.isNotNull()
    sums = rows.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(~tax, amount)), F.lit(0)).alias("_s"), F.count_if(~tax & ~made_up & F.col("amount").isNotNull()).alias("_n")
    )
    fields = [F.coalesce(F.col(k), F.lit(0)) for k in TAX_LABELS if k in receipts.columns]
    taxes = sum(fields, F.lit(0).cast(AMOUNT))
    j = receipts.select(*key, F.col("amount").alias("_total"), taxes.alias("_t")).join(sums, key, "left")
    fits = (F.col("_n") >= 2) & (F.abs(F.col("_s") + F.col("_t") - F.col("_total")) <= F.lit("0.05").cast("decimal(3,2)"))
    return j.select(*key, F.coalesce(fits, F.lit(False)).alias("fits"), F.col("_n").isNotNull().alias("any"))


def merge_external(local_lines: DataFrame, external_lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """TXT19: lines of each receipt after an outside extraction.

    Local lines stay when they reconcile with the total and the external ones do not; otherwise the external lines are
    used. Of local lines that stay, an unnamed tax line that repeats the tax fields goes. Local alcohol evidence wins, an
    explicit local non-alcohol (confidence >= .99 for a reason found in the text) vetoes the external flag; a blank
    line or one without evidence vetoes nothing.
    """
    key = ["trip_id", "source_file"]
    ours_fit = lines_reconcile(local_lines, receipts).select(*key, F.col("fits").alias("local"))
    theirs_fit = lines_reconcile(external_lines, receipts).select(*key, F.col("fits").alias("external"), F.col("any").alias("external_any"))
    fields = [F.coalesce(F.col(k), F.lit(0)) for k in TAX_LABELS if k in receipts.columns]
    taxes = receipts.select(*key, sum(fields, F.lit(0).cast(AMOUNT)).alias("_tax"))
    choice = ours_fit.join(theirs_fit, key).select(
        *key, (~F.col("external_any") | (F.col("local") & ~F.col("external"))).alias("use_local"), "external_any"
    )
    repeats_tax = (
        F.col("external_any") & (F.col("_tax") != 0) & F.trim(F.coalesce("description", F.lit(""))).rlike(r"(?i)^(?:sales\s+)?tax(?:es)?$")
        & (F.abs(F.col("amount") - F.col("_tax")) <= F.lit("0.05").cast("decimal(3,2)"))
    )
    ours = local_lines.join(choice.filter("use_local"), key).join(taxes, key).filter(~F.coalesce(repeats_tax, F.lit(False))).select(
        *key, "pos", "description", "amount", "is_alcohol", "alcohol_confidence", F.lit("local").alias("origin")
    )
    veto = ~F.col("is_alcohol") & (F.col("alcohol_confidence") >= 0.99) & ~F.col("alcohol_reason").isin(NO_EVIDENCE)
    flagged = F.col("is_alcohol") | (F.col("external_alcohol") & ~veto)
    theirs = external_lines.join(choice.filter("not use_local"), key, "left_semi").select(
        *key,
        "pos",
        "description",
        "amount",
        flagged.alias("is_alcohol"),
        F.when(F.col("external_alcohol") & ~veto & ~F.col("is_alcohol"), F.col("external_confidence"))
        .otherwise(F.col("alcohol_confidence"))
        .alias("alcohol_confidence"),
        F.lit("external").alias("origin"),
    )
    return ours.unionByName(theirs)


def enrich_from_statement(receipts: DataFrame, best: DataFrame) -> DataFrame:
    """ENR1: junk vendors take the merchant of the first card row matched with confidence >= .55.

    best: trip_id, group_id, source_file, score, description, transaction_date.
    """
    from tripledger.functions.cleaners import BREAKFAST_WORDS, FOOD_WORDS, merchant_clean

    merchant = merchant_clean(F.col("description"))
    food = contains_any(F.lower(F.concat_ws(" ", merchant, F.col("description"))), FOOD_WORDS)
    order = F.struct("transaction_date", "group_id")
    hits = (
        best.filter("score >= 0.55")
        .withColumns({"merchant": merchant, "food": food})
        .filter("merchant <> ''")
        .groupBy("trip_id", "source_file")
        .agg(
            F.min_by(F.struct("merchant", "description"), order).alias("_first"),
            F.min_by(F.when(F.col("food"), F.col("merchant")), F.when(F.col("food"), order)).alias("_food"),
        )
    )
    vendor = F.lower(F.coalesce("vendor", F.lit("")))
    junk = (
        (vendor == "")
        | vendor.isin("tax ywvol", "tax invoice", "unknown supplier")
        | vendor.rlike(r"(?U)\b(tax|invoice|receipt|scanned)\b")
    )
    j = receipts.join(hits, ["trip_id", "source_file"], "left")
    text = F.coalesce("raw_text", F.lit("")) if "raw_text" in receipts.columns else F.lit("")
    blob = F.lower(F.concat_ws(" ", text, F.col("_food")))
    replace = F.col("_first").isNotNull() & junk
    kind = F.coalesce("expense_type", F.lit(""))
    meal = (
        F.when(F.col("_food").isNull() | kind.startswith("meal"), F.col("expense_type"))
        .when(contains_any(blob, BREAKFAST_WORDS), F.lit("meal-breakfast"))
        .otherwise(F.lit("meal-dinner"))
    )
    note = F.concat(F.lit("Supplier inferred from card statement: "), F.col("_first.description"), F.lit("."))
    return j.withColumns(
        {
            "vendor": F.when(replace, F.col("_first.merchant")).otherwise(F.col("vendor")),
            "review_note": F.when(replace, append_note(F.col("review_note"), note)).otherwise(F.col("review_note")),
            "expense_type": F.when(meal.startswith("meal"), F.lit("meal")).otherwise(meal),
        }
    ).drop("_first", "_food")
