"""Money amounts inside a text line, with native regular expressions (TXT2).

Each hit is rewritten to a marked token, widest pattern first; a later pattern skips text that is
already marked. The marked line then yields both the amounts and the text around them, so no
per-row Python and no position bookkeeping is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripledger.functions.cleaners import bind

# Fixed values
CURRENCIES = ["AUD", "CAD", "USD", "IDR", "EUR", "GBP", "VND", "QAR", "HKD", "CHF"]
CUR = "|".join(CURRENCIES) + r"|AU\$|CA\$|\$"
ADDITIVE = r"(?iU)\b(?:gst|tax|vat|surcharge|service\s+(?:fee|charge)|gratuity|tip)\b"

OPEN, CLOSE = "\u0001", "\u0002"
_FREE = f"(?![^{OPEN}{CLOSE}]*+{CLOSE})"  # not inside a token; looked at only behind an amount
_AMT = r"-?(?:\d{1,3}(?:,\d{3})+|\d+,\d{2}|\d+)(?:\.\d{2})?"
_BROKEN = rf"(?i)({CUR})\s*(\d+)\.\s+(\d{{2}})(?!\d)"
_SPLIT = rf"(?i)({CUR})\s*(\d{{1,3}})\s+(\d+\.\d{{2}}){_FREE}"
# An amount glued to a letter before it is its own branch: a capture inside a look-behind would
# keep its value from earlier start positions. The first letters of currencies and amounts are looked for first.
_PLAIN = (
    rf"(?i)(?=[-$\s\dACEGHIQUV])(?:(?=[-\d])(?<=\p{{L}})({_AMT})|(-)?\s*({CUR})?\s*({_AMT})){_FREE}(?=(\s+\d{{3}})?)(?=(\p{{L}})?)"
)


def mark_money(line: Column) -> Column:
    """Line with tokens ``\\u0001sign|cur|glued|amount|follow|after\\u0002``."""
    token = lambda s: OPEN + s + CLOSE
    # the first two notations have a gap between digits, which few lines have and which is found faster than a currency
    out = F.when(line.rlike(r"\d\.\s+\d"), F.regexp_replace(line, _BROKEN, token("|$1||$2.$3||"))).otherwise(line)
    split = lambda s: F.when(s.rlike(r"\d\s+\d+\.\d"), F.regexp_replace(s, _SPLIT, token("|$1||$2$3||"))).otherwise(s)
    return F.regexp_replace(bind(out, split), _PLAIN, token("$2|$3|$1|$4|$5|$6"))


def _parse(token: Column, additive: Column) -> Column:
    """Amount and currency of one token; null for one that is no amount. Each part is computed once."""

    def of_parts(f: Column) -> Column:
        sign, cur, glued, free = (f[i] for i in range(4))
        raw = F.when(glued != "", glued).otherwise(free)
        signed = F.when((sign != "") & ~raw.startswith("-"), F.concat(F.lit("-"), raw)).otherwise(raw)
        return bind(F.struct(raw.alias("raw"), signed.alias("signed"), cur.alias("cur")), lambda x: of_amount(f, x))

    def of_amount(f: Column, x: Column) -> Column:
        cur, glued, follow, after = f[1], f[2], f[4], f[5]
        bare = ~x["raw"].contains(".") & ~x["raw"].contains(",")
        valid = F.when(cur != "", ~(bare & (follow != ""))).otherwise(~bare & (glued == "") & (after == ""))
        commas = F.when(x["signed"].rlike(r"^-?\d{1,3},\d{2}$"), F.translate(x["signed"], ",", ".")).otherwise(F.translate(x["signed"], ", ", ""))
        compact = F.when(x["signed"].contains(",") | x["signed"].contains(" "), commas).otherwise(x["signed"])
        return F.when(valid, bind(compact, lambda c: of_number(cur, c)))

    def of_number(cur: Column, compact: Column) -> Column:
        number = F.when(
            (cur != "") & ~compact.contains(".") & compact.rlike(r"^0?\d{2}$") & additive,
            F.concat(F.lit("0."), F.right(compact, F.lit(2))),
        ).otherwise(compact)
        return bind(
            number.try_cast("decimal(18,2)"),
            lambda amount: F.when(
                amount.isNotNull(),
                F.struct(amount.alias("amount"), F.when(cur != "", F.upper(cur)).alias("currency"), token.alias("token")),
            ),
        )

    return bind(F.split(token, r"\|", -1), of_parts)


def money_tokens(marked: Column) -> Column:
    """array<struct<amount, currency, token>> of the valid amounts of a marked line, in pattern order."""
    additive = marked.rlike(ADDITIVE)
    raw = F.regexp_extract_all(marked, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))
    return F.array_compact(F.transform(raw, lambda t: _parse(t, additive)))


def strip_tokens(marked: Column) -> Column:
    return F.regexp_replace(marked, f"{OPEN}[^{CLOSE}]*{CLOSE}", "")


def line_info(line: Column) -> Column:
    """struct(text, marked, money) of one line. Every amount has an ASCII digit: lines without one are not searched."""
    marked = F.when(line.rlike("[0-9]"), mark_money(line)).otherwise(line)
    return bind(marked, lambda m: F.struct(line.alias("text"), m.alias("marked"), money_tokens(m).alias("money")))
