"""Scalar cleaners of statement and receipt text as Column expressions (TXT16, TXT17, LAY1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
CURRENCY_SYMBOLS = {
    "C$": "CAD", "CA$": "CAD", "US$": "USD", "A$": "AUD", "AU$": "AUD", "€": "EUR", "£": "GBP", "¥": "JPY", "$": "CAD",
}
CURRENCY_NAMES = {
    "AUSTRALIAN DOLLAR": "AUD",
    "CANADIAN DOLLAR": "CAD",
    "US DOLLAR": "USD",
    "INDONESIAN RUPIAH": "IDR",
    "VIETNAMESE DONG": "VND",
    "QATARI RIYAL": "QAR",
    "HONG KONG DOLLAR": "HKD",
    "SWISS FRANC": "CHF",
}
KNOWN_MERCHANTS = {
    "FARMERS DAUGHTER": "Farmers Daughters",
    "NIGEL": "Nigel",
    "REINE": "Reine & La Rue",
    "GABRIEL": "Gabriel",
    "INTERMISSION": "Intermission",
}
CITY_TAILS = ["MELBOURNE", "HAWTHORN EAST", "WANTIRNA", "SYDNEY", "LONDON", "JAKARTA BARAT", r"HELP\.UBER\.COM"]
FOOD_WORDS = ["farmers", "nigel", "reine", "gabriel", "intermission", "espresso", "cafe", "restaurant", "hanks"]
BREAKFAST_WORDS = ["breakfast", "cappuccino", "benedict", "banana bread", "espresso"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))


def normalize_key(value: Column) -> Column:
    """LAY1: lower-case snake key of a header."""
    raw = F.lower(F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "^﻿+", "")))
    return F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as a variable in ``body``: keeps long rules small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finds(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)`` for a pattern that begins with (?iU) or (?U).

    The Unicode classes are slow and mean the same in an ASCII text, which is searched without them.
    """
    plain = pattern.replace("(?iU)", "(?i)", 1) if pattern.startswith("(?iU)") else pattern.replace("(?U)", "", 1)
    return F.when(is_ascii(text), text.rlike(plain)).otherwise(text.rlike(pattern))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def currency_code(value: Column) -> Column:
    def rule(text: Column) -> Column:
        found = F.regexp_extract(text, r"(?U)\b([A-Z]{3})\b", 1)
        return F.when(found != "", found).otherwise(literal_map(CURRENCY_SYMBOLS)[text])

    return bind(F.upper(clean_text(value)), rule)


def parse_number(value: Column, kind: str = "decimal(28,8)") -> Column:
    """Number in any of the usual locales; parentheses or a CR suffix make it negative."""

    def plain(digits: Column) -> Column:
        short = F.length(F.regexp_extract(digits, r"[,.]([^,.]*)$", 1)).isin(1, 2)
        commas, dots = digits.contains(","), digits.contains(".")
        strip = lambda pattern: F.regexp_replace(digits, pattern, "")
        return (
            F.when(
                commas & dots,
                F.when(short & digits.rlike(r",[^.,]*$"), F.translate(strip(r"\."), ",", "."))
                .when(short, strip(","))
                .otherwise(strip("[,.]")),
            )
            .when(commas, F.when(short, F.translate(strip(",(?=.*,)"), ",", ".")).otherwise(strip(",")))
            .when(digits.rlike(r"\..*\."), F.when(short, strip(r"\.(?=.*\.)")).otherwise(strip(r"\.")))
            .otherwise(digits)
        )

    def rule(text: Column) -> Column:
        negative = text.rlike(r"^\(.*\)$|(?i:\bCR\s*$)")
        body = F.regexp_replace(text, r"(?i)\b(?:CR|DR)\s*$", "")
        digits = bind(F.regexp_replace(body, r"[^0-9,.+\-]", ""), plain)
        number = bind(digits, lambda n: F.when(n.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), n).try_cast(kind))
        return F.when(negative, -number).otherwise(number)

    return bind(F.regexp_replace(clean_text(value), "[\u00a0\u202f]", ""), rule)


_PARTS = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})(?:\D.*|$)"


def numeric_date_parts(value: Column) -> Column:
    """struct(first, second, year) of d/m/y or m/d/y text, else null."""

    def rule(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, _PARTS, i).cast("int")
        year = bind(part(3), lambda y: F.when(y < 100, y + 2000).otherwise(y))
        return F.when(
            text.rlike(_PARTS), F.struct(part(1).alias("first"), part(2).alias("second"), year.alias("year"))
        )

    return bind(clean_text(value), rule)


_ISO = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"
_STAMP = r"^(\d{4})-(\d{1,2})-(\d{1,2}) \d{1,2}:\d{1,2}:\d{1,2}$"
_NAMED = (
    r"^(?:(\d{1,2})-([A-Za-z]+)-(\d{2})|(\d{1,2}) ([A-Za-z]+) (\d{4}|\d{2})|(\d{1,2}) ([A-Za-z]{3})\. (\d{4}))$"
)
_DOTTED = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$"


def _full_year(text: Column) -> Column:
    old = F.regexp_replace(text, r"(?<= )(69|[7-9]\d)$", "19$1")
    return F.regexp_replace(old, r"(?<= )(\d\d)$", "20$1")


def _formatted_date(c: Column) -> Column:
    named = bind(
        _full_year(F.regexp_replace(c, _NAMED, "$1$4$7 $2$5$8 $3$6$9")),
        lambda t: F.coalesce(F.try_to_date(t, "d MMM yyyy"), F.try_to_date(t, "d MMMM yyyy")),
    )
    return (
        F.when(c.rlike(_ISO), F.try_to_date(F.regexp_replace(c, _ISO, "$1-$3-$4"), "yyyy-M-d"))
        .when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
        .when(c.rlike(_NAMED), named)
        .when(c.rlike(_DOTTED), F.try_to_date(_full_year(F.regexp_replace(c, _DOTTED, "$1 $2 $3")), "d M yyyy"))
        .when(c.rlike(_STAMP), F.try_to_date(F.regexp_replace(c, _STAMP, "$1-$2-$3"), "yyyy-M-d"))
    )


def parse_date(value: Column, convention: Column) -> Column:
    """Date in one of the fixed formats; d/m/y or m/d/y text follows the file's convention."""

    def numeric(p: Column) -> Column:
        a, b = p["first"], p["second"]
        order = (
            F.when((a > 12) & (b <= 12), F.lit("day_first"))
            .when((b > 12) & (a <= 12), F.lit("month_first"))
            .otherwise(convention)
        )
        day = F.when(order == "day_first", a).when(order == "month_first", b)
        month = F.when(order == "day_first", b).when(order == "month_first", a)
        return F.when(
            day.isNotNull(),
            F.try_to_date(F.concat_ws("-", p["year"].cast("string"), month.cast("string"), day.cast("string")), "yyyy-M-d"),
        )

    def rule(text: Column) -> Column:
        tries = F.array(text, F.substring(text, 1, 10), F.substring(text, 1, 11))
        hits = F.array_compact(F.transform(tries, _formatted_date))
        return F.coalesce(F.get(hits, F.lit(0)), bind(numeric_date_parts(text), numeric))

    return bind(clean_text(value), rule)


_FOREIGN = r"(-?\d+(?:\.\d+)?)\s+([A-Z ]+)"


def foreign_value(value: Column) -> Column:
    """struct(amount, currency) of text such as ``123.45 US DOLLAR``."""

    def rule(text: Column) -> Column:
        amount = F.regexp_extract(text, _FOREIGN, 1).try_cast("decimal(28,8)")
        name = F.trim(F.regexp_extract(text, _FOREIGN, 2))
        code = bind(name, lambda n: F.coalesce(literal_map(CURRENCY_NAMES)[n], F.left(n, F.lit(3))))
        return F.struct(amount.alias("amount"), F.when(amount.isNotNull(), code).alias("currency"))

    return bind(F.regexp_replace(F.upper(clean_text(value)), ",", ""), rule)


def mask_account(value: Column) -> Column:
    digits = F.regexp_replace(clean_text(value), r"\D", "")
    return F.when(digits != "", F.concat(F.lit("••••"), F.right(digits, F.lit(4)))).otherwise(F.lit(""))


def stable_hash(*values: Column) -> Column:
    """First 12 hex digits of sha1 over the values; null and zero count as empty."""
    parts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(12))


def classify_credit(description: Column) -> Column:
    return (
        F.when(description.rlike("(?i)cashback|cash back|reward|rebate"), F.lit("cashback"))
        .when(description.rlike("(?i)payment"), F.lit("payment"))
        .when(description.rlike("(?i)deposit"), F.lit("deposit"))
        .when(description.rlike("(?i)transfer"), F.lit("transfer"))
        .otherwise(F.lit("refund"))
    )


def title_words(text: Column) -> Column:
    return F.array_join(
        F.transform(
            F.split(text, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        ),
        " ",
    )


def merchant_clean(description: Column) -> Column:
    """TXT17: merchant name of a card description."""
    text = clean_text(description)
    text = F.regexp_replace(text, r"^[A-Z]{2,4}\*", "")
    text = F.regexp_replace(text, rf"(?i)\b({'|'.join(CITY_TAILS)})\b.*$", "")
    text = F.regexp_replace(text, r"^[ -]+|[ -]+$", "")
    upper = F.upper(text)
    known = F.coalesce(*[F.when(upper.contains(k), F.lit(v)) for k, v in KNOWN_MERCHANTS.items()])
    return F.coalesce(known, title_words(text))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out
