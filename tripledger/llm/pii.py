"""Personal data: validated patterns, and boosted trees over the spans of looser generators, in DataFrame functions only.

The base patterns decide by format and check digits. Looser generators propose more spans, also overlapping ones.
A proposal is confirmed where the base finds the same kind, or where it passes the checks of its kind once its disguise is
taken off ((at), (dot), separators), for phones by the number plan or a word before it. Trees are fitted on all
proposals from format and context features; their scores are calibrated for each generator by itself to the share that
is confirmed, and each generator keeps those of a high share.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.llm import boosting

KINDS = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# The fixed patterns of the base. Runs are taken whole, and a match starts at the head of its run or at the last
# match's end: this finds the same matches as plain quantifiers, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAME = r"[^\s@<>()\[\]\x22,;:]"
LOOSE = {
    "email": [
        rf"(?:(?<!{_NAME})|\G){_NAME}++@{_NAME}++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
    ],
    "ip": [r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"],
    "card": [r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])"],
    "phone": [r"(?<![0-9A-Za-z.])[+(]?[0-9][\x20().0-9/-]{5,18}[0-9](?![0-9A-Za-z])"],
}
MAY_HOLD = r"[0-9@]|[(\[{]at[)\]}]"
GENERATORS = [(kind, pattern) for kind in KINDS for pattern in LOOSE[kind]]
#: Words that speak for a kind when they stand on the same line within CONTEXT characters before a span.
CONTEXT = 24
SPEAKS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b[^\n]*$", "ip": r"(?i)\b(?:ip|host|server|address|from)\b[^\n]*$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit)\b[^\n]*$", "phone": r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|whatsapp)\b[^\n]*$",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits (any number of them) pass the check-sum."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    n = F.length(digits)
    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def _valid(kind: str, found: Column) -> Column:
    """Whether a match of the base pattern passes the checks of its kind."""
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(found))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(found))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


SPAN = "array<struct<start:int,kind_no:int,end:int,found:string,before:string,generator:int,after:string>>"


def _spans(text: Column, kind: str, pattern: str, checked: bool, generator: int = -1) -> Column:
    """Matches of a pattern in text order: array of SPAN, offsets in code points; before: the characters before the match.

    checked: only those that pass the checks of the kind; the others still take their place.
    """
    kind_no = KINDS.index(kind)
    keep = (lambda m: _valid(kind, m)) if checked else (lambda m: F.lit(True))
    empty = F.array().cast(SPAN)

    def collect(gaps: Column, found: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            gap, match = F.get(gaps, i), F.get(found, i)
            start = state["at"] + F.length(gap)
            end = start + F.length(match)
            span = F.struct(
                start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), match.alias("found"),
                F.right(gap, F.lit(CONTEXT)).alias("before"), F.lit(generator).alias("generator"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
            )
            return F.struct(end.alias("at"), F.when(keep(match), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda state: state["out"])
        return F.when(F.size(found) > 0, walked).otherwise(empty)

    split = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(F.struct(split.alias("gaps"), matches.alias("found")), lambda x: collect(x["gaps"], x["found"]))


def _speaks(span: Column) -> Column:
    """Whether a word before the span speaks for its kind."""
    return F.coalesce(*(F.when(span["kind_no"] == i, span["before"].rlike(SPEAKS[k])) for i, k in enumerate(KINDS)))


def _confirmed(span: Column) -> Column:
    """Whether a proposal passes the checks of its kind without its disguise."""
    found = span["found"]
    digits = _digits(found)
    bare = F.regexp_replace(F.regexp_replace(found, r" ?[(\[{]at[)\]}] ?", "@"), r" ?[(\[{]dot[)\]}] ?", ".")
    email = bare.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,12}$") & ~bare.contains("..")
    six = found.rlike(r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$") & found.rlike("[1-9A-Fa-f]")
    grouped = found.rlike(r"^[3-6][0-9]{3}(?:[ .-][0-9]{4}){2,3}(?:[ .-][0-9]{1,3})?$|^3[47][0-9]{2}[ .-][0-9]{6}[ .-][0-9]{5}$")
    card = F.length(digits).between(13, 19) & _luhn(digits) & (grouped | _speaks(span))
    plan = found.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$")
    phone = F.length(digits).between(7, 15) & (plan | (_speaks(span) & found.rlike(r"[\x20()./-]")))
    kinds = (email, six | _valid("ip", found), card, phone)
    return F.coalesce(*(F.when(span["kind_no"] == i, c) for i, c in enumerate(kinds)), F.lit(False))


_FEATURES = ("digits", "others", "letters", "dots", "before", "after", "opens", "variety", "check", "speaks", "shape", "generator")


def _features(span: Column) -> list[Column]:
    """Whole numbers from a few values each: format first, then context, then the kind."""
    found = span["found"]
    n = F.length(_digits(found))
    letters = F.length(F.regexp_replace(found, r"\P{L}+", ""))

    def bucket(x: Column, *limits: int) -> Column:
        return sum(((x > at).cast("int") for at in limits[1:]), (x > limits[0]).cast("int"))

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)

    tail = found.rlike(r"\.[A-Za-z]{2,12}$|[)\]}] ?[A-Za-z]{2,12}$")
    check = (
        F.when(span["kind_no"] == 0, tail & ~found.rlike(r"\.\.")).when(span["kind_no"] == 1, _valid("ip", found) | found.contains(":"))
        .when(span["kind_no"] == 2, _luhn(_digits(found))).otherwise(n.between(10, 15))
    )
    # groups of digits: three, three and four; fours; others
    shape = F.when(found.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$"), 1).when(found.rlike(r"^[3-6][0-9]{3}(?:[ .-][0-9]{4}){2,3}"), 2).otherwise(0)
    variety = F.size(F.array_distinct(F.split(_digits(found), "")))
    return [
        bucket(n, 0, 6, 9, 12, 13, 15, 16, 19), bucket(F.length(found) - n - letters, 0, 1, 3, 5), bucket(letters, 0, 3),
        bucket(F.length(found) - F.length(F.translate(found, ".", "")), 0, 1, 2, 3), side(F.right(span["before"], F.lit(1))), side(span["after"]),
        F.when(found.startswith("+"), 2).when(found.startswith("("), 1).otherwise(0), bucket(variety, 2, 4), check.cast("int"),
        _speaks(span).cast("int"), shape, span["generator"],
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """key, base spans and loose candidates (with features and label) of each row. docs: key, text; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(SPAN)
    held = docs.select("key", text.alias("text")).withColumn("may", F.col("text").rlike(MAY_HOLD))

    def spans(patterns: list[tuple[str, str]], checked: bool) -> Column:
        every = [_spans(F.col("text"), kind, p, checked, i) for i, (kind, p) in enumerate(patterns)]
        return F.when(F.col("may"), F.concat(*every)).otherwise(none)

    found = held.select(
        "key", F.sort_array(spans(list(BASE.items()), True)).alias("base"),
        F.sort_array(spans(GENERATORS, False)).alias("loose"),
    )

    def described(span: Column, base: Column) -> Column:
        meets = F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        same = F.exists(base, lambda b: (b["kind_no"] == span["kind_no"]) & (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return F.struct(
            span["start"].alias("start"), span["kind_no"].alias("kind_no"), span["end"].alias("end"),
            F.array(*_features(span)).alias("x"), meets.alias("meets"), (same | _confirmed(span)).alias("label"),
        )

    return found.select(
        "key", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"))).alias("base"),
        F.transform("loose", lambda s: described(s, F.col("base"))).alias("loose"),
    )


def calibrated(levels: dict[float, list[float]]) -> list[tuple[float, float]]:
    """(lowest score, share of label 1) of pooled score levels, highest first: neighbours are pooled until the shares fall with the score."""
    pools: list[list[float]] = []
    for s in sorted(levels, reverse=True):
        pools.append([s, *levels[s]])
        while len(pools) > 1 and pools[-1][2] * (pools[-2][1] + pools[-2][2]) >= pools[-2][2] * (pools[-1][1] + pools[-1][2]):
            low = pools.pop()
            pools[-1] = [low[0], pools[-1][1] + low[1], pools[-1][2] + low[2]]
    return [(s, ones / (zeros + ones)) for s, zeros, ones in pools]


class Scorer:
    """Trees and a threshold for each generator."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], float, float]], precision: float):
        self.trees = boosting.fit(patterns)
        self.thresholds: dict[int, float] = {}
        for generator in range(len(GENERATORS)):
            own = [(boosting.score(self.trees, x), n0, n1) for x, n0, n1 in patterns if x[-1] == generator]
            levels: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for s, n0, n1 in own:
                levels[s][0] += n0
                levels[s][1] += n1
            passing = [least for least, rate in calibrated(levels) if rate >= precision]
            if passing:
                self.thresholds[generator] = min(passing)

    def selects(self, span: Column) -> Column:
        odds = boosting.log_odds(self.trees, [F.get(span["x"], F.lit(i)) for i in range(len(_FEATURES))])
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
        passes = F.lit(False)
        for generator, least in self.thresholds.items():
            passes = passes | ((F.get(span["x"], F.lit(len(_FEATURES) - 1)) == generator) & (score >= least - 1e-9))
        return passes


def fit(found: DataFrame, precision: float = 0.9) -> Scorer:
    """Scorer from all candidates. The feature patterns that reach the driver are bounded by the ranges of the features, whatever the corpus."""
    x = found.select(F.explode("loose").alias("c")).groupBy("c.x").agg(F.sum((~F.col("c.label")).cast("long")).alias("n0"), F.sum(F.col("c.label").cast("long")).alias("n1"))
    return Scorer([(tuple(r.x), float(r.n0), float(r.n1)) for r in x.collect()], precision)


def _all_spans(scorer: Scorer) -> Column:
    """Base spans, and selected candidates that meet none of them; of overlapping ones the first, then the longest, stays."""
    chosen = F.filter("loose", lambda c: ~c["meets"] & scorer.selects(c))
    plain = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")

    def add(kept: Column, s: Column) -> Column:
        span = F.array(F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))
        clash = F.coalesce(F.element_at(kept, -1)["end"] > s["start"], F.lit(False))
        return F.when((F.size(kept) > 0) & clash, kept).otherwise(F.concat(kept, span))

    added = F.when(F.size(plain) > 0, F.aggregate(F.sort_array(plain), empty, lambda kept, s: F.when(F.size(kept) == 0, F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"))))).otherwise(add(kept, s)))).otherwise(empty)
    return F.sort_array(F.concat("base", added))


def find(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """Spans of each document: (doc_id, base, spans), arrays of (start, kind_no, end) by start, offsets in code points.

    docs: doc_id, text; other columns are not read. Null and empty texts have no spans. Every repeated row gets its
    spans; an empty table gives an empty one.
    """
    found = materialize(candidates(docs.select(F.col("doc_id").alias("key"), "text")))
    return found.select(F.col("key").alias("doc_id"), "base", _all_spans(fit(found, precision)).alias("spans"))


def redact(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """docs with its spans replaced by the name of their kind in angle brackets; all columns stay.

    A null text stays null and an empty one empty; every repeated row is redacted by itself; an empty table gives an empty one.
    """
    scorer = fit(candidates(docs.select(F.lit(1).alias("key"), "text")), precision)
    spans = candidates(docs.select(F.struct(*docs.columns).alias("key"), "text")).select("key", _all_spans(scorer).alias("spans"))
    text = F.col("key.text")
    tag = lambda s: F.get(F.array(*(F.lit(f"<{k}>") for k in KINDS)), s["kind_no"])
    # a span that begins inside an earlier one adds only its tail
    reach = lambda i: F.when(i > 0, F.array_max(F.transform(F.slice("spans", F.lit(1), i), lambda s: s["end"]))).otherwise(0)
    pieces = F.transform("spans", lambda s, i: F.concat(F.substr(text, reach(i) + 1, F.greatest(s["start"] - reach(i), F.lit(0))), F.when(s["start"] >= reach(i), tag(s)).otherwise("")))
    rest = F.substr(text, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(text))
    new = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return spans.select(F.col("key").withField("text", new).alias("key")).select("key.*")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a hash of them, and all spans as text."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind_no"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = [F.coalesce(F.get(F.col("n"), F.lit(i)), F.lit(0)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    zeros = F.array(*(F.lit(0) for _ in KINDS))
    tally = F.aggregate("base", zeros, lambda n, s: F.transform(n, lambda x, i: x + (i == s["kind_no"]).cast("int")))
    return found.withColumn("n", tally).select("doc_id", *count, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
