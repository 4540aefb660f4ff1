"""Quality by weak supervision, in DataFrame functions only.

Rules vote good or bad or abstain. Expectation-maximisation over the table of vote patterns estimates how often
each rule calls a good and a bad document bad; the posterior probability of "good" is the verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words in windows of 8 words that are found twice or more in the text."""

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    def repeated(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda s, i: (F.get(ordered, i - 1)["h"] == s["h"]) | (F.get(ordered, i + 1)["h"] == s["h"]),
        )

    def starts(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.sort_array(F.transform(_let(ordered, repeated), lambda s: s["at"]))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    within = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(starts(h), covered)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= WINDOW, within).otherwise(F.lit(0).cast("long"))


def signals(docs: DataFrame) -> DataFrame:
    """docs with a struct of counts over the whole text; a null text counts as empty.

    docs has the columns key (anything) and text; the result has key and signals.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("key", text.alias("text")).withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    with_word = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.withColumn("lines", with_word)
    count = lambda c: c.cast("long")
    return counted.select(
        "key",
        F.struct(
            count(F.size("words")).alias("n_words"),
            count(F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
            count(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
            count(F.length("text") - F.length(F.translate("text", "|", ""))).alias("n_bars"),
            count(F.size("lines")).alias("n_lines"),
            count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
            _repeated_words(F.col("words")).alias("n_repeat_words"),
            count(F.length(F.regexp_replace("text", r"\P{Lu}+", ""))).alias("n_upper"),
            count(F.length(F.regexp_replace("text", r"\P{L}+", ""))).alias("n_letters"),
            count(F.size(F.array_distinct("words"))).alias("n_kinds"),
        ).alias("signals"),
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """Each rule: when it votes bad, when it votes good; else it abstains. A text without words gets bad from the first only."""
    s = {c: F.col(f"signals.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_bars", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_kinds")}
    some = s["n_words"] > 0

    def share(part: str, whole: str, good: float, bad: float) -> tuple[Column, Column]:
        return some & (s[part] > bad * s[whole]), some & (s[part] <= good * s[whole])

    return {
        "few_words": (s["n_words"] < 20, s["n_words"] >= 30),
        "word_length": (some & ((s["word_chars"] < 2.5 * s["n_words"]) | (s["word_chars"] > 14 * s["n_words"])), some & s["word_chars"].between(3 * s["n_words"], 11 * s["n_words"])),
        "symbols": share("n_symbols", "n_words", 0.02, 0.1),
        "table_cells": share("n_bars", "n_words", 0.02, 0.1),
        "lines_again": share("n_dup_lines", "n_lines", 0.1, 0.5),
        "words_again": share("n_repeat_words", "n_words", 0.1, 0.3),
        "capitals": share("n_upper", "n_letters", 0.2, 0.5),
        "not_letters": (some & (s["n_letters"] < 0.7 * s["word_chars"]), some & (s["n_letters"] >= 0.85 * s["word_chars"])),
        "few_kinds": (some & (s["n_kinds"] * s["n_kinds"] < 2 * s["n_words"]), some & (s["n_kinds"] * s["n_kinds"] >= 4 * s["n_words"])),
    }


def votes() -> Column:
    """Votes of all rules, as an array in their order."""
    return F.array(*(F.when(F.coalesce(bad, F.lit(False)), BAD).when(F.coalesce(good, F.lit(False)), GOOD).otherwise(ABSTAIN) for bad, good in rules().values()))


def fit(voted: DataFrame, rounds: int = 30) -> DataFrame:
    """Posterior probability of "good" for each vote pattern: (votes, p_good).

    voted has a column votes. The pattern counts cover every row; there are 3 ** rules patterns at most, so the
    one row that holds them is bounded, whatever the corpus. A rule's chance to call a good document bad
    stays within 0.001 and 0.05, a bad one within 0.2 and 0.95, the share of good documents within 0.3
    and 0.98; so the classes can't change places. An empty table has no patterns.
    """
    n_rules = len(rules())
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    clamp = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)

    def posterior(pattern: Column, theta: Column) -> Column:
        def weight(vote: Column, j: Column) -> Column:
            g, b = F.get(theta["bad_if_good"], j), F.get(theta["bad_if_bad"], j)
            return F.when(vote == BAD, F.log(g / b)).when(vote == GOOD, F.log((1 - g) / (1 - b))).otherwise(0.0)

        odds = F.log(theta["prior"] / (1 - theta["prior"])) + total(F.transform(pattern, weight))
        return 1 / (1 + F.exp(-odds))

    def improve(p: Column, theta: Column) -> Column:
        def with_posteriors(q: Column) -> Column:
            def rate(j: Column, good: bool) -> Column:
                mass = lambda x: x["n"] * (x["q"] if good else 1 - x["q"])
                said = total(F.transform(q, lambda x: F.when(F.get(x["votes"], j) != ABSTAIN, mass(x)).otherwise(0.0)))
                bad = total(F.transform(q, lambda x: F.when(F.get(x["votes"], j) == BAD, mass(x)).otherwise(0.0)))
                return (bad + 0.01) / (said + 1.0)

            numbers = F.sequence(F.lit(0), F.lit(n_rules - 1))
            n = total(F.transform(q, lambda x: x["n"]))
            return F.struct(
                clamp(total(F.transform(q, lambda x: x["n"] * x["q"])) / n, 0.3, 0.98).alias("prior"),
                F.transform(numbers, lambda j: clamp(rate(j, True), 0.001, 0.05)).alias("bad_if_good"),
                F.transform(numbers, lambda j: clamp(rate(j, False), 0.2, 0.95)).alias("bad_if_bad"),
            )

        return _let(F.transform(p, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), posterior(x["votes"], theta).alias("q"))), with_posteriors)

    start = F.struct(
        F.lit(0.8).alias("prior"),
        F.array_repeat(F.lit(0.02), n_rules).alias("bad_if_good"),
        F.array_repeat(F.lit(0.4), n_rules).alias("bad_if_bad"),
    )
    fitted = table.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda theta, _: improve(F.col("p"), theta)).alias("theta"))
    return fitted.select(F.explode("p").alias("x"), "theta").select("x.votes", posterior(F.col("x.votes"), F.col("theta")).alias("p_good"))


def base_failed() -> Column:
    return (F.col("signals.n_words") < 20) | (100 * F.col("signals.n_repeat_words") > 30 * F.col("signals.n_words"))


def verdicts(docs: DataFrame, keep_above: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict of each document.

    docs: doc_id, text; other columns are not read. Null and empty texts have no words, so they fail the base.
    Every repeated row gets its verdict; an empty table gives an empty one.
    """
    voted = materialize(signals(docs.select(F.col("doc_id").alias("key"), "text")).withColumn("votes", votes()))
    judged = voted.join(materialize(fit(voted)), "votes")
    s = [F.col(f"signals.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select(
        F.col("key").alias("doc_id"), *s, base_failed().alias("base_failed"),
        (~base_failed() & (F.col("p_good") > keep_above)).alias("kept"), F.round("p_good", 6).alias("p_good"), "votes",
    )


def keep_good(docs: DataFrame, keep_above: float = 0.5) -> DataFrame:
    """The rows of docs (all columns) that pass the base and whose posterior is high enough.

    Counts are made once and written; the verdicts meet the rows by doc_id and a hash of the text, so equal rows share theirs.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    voted = materialize(signals(docs.select(key.alias("key"), "text")).withColumn("votes", votes()))
    judged = voted.join(materialize(fit(voted)), "votes").filter(~base_failed() & (F.col("p_good") > keep_above))
    kept = judged.select(F.col("key").alias("kept_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    same = F.col("key.doc_id").eqNullSafe(F.col("kept_key.doc_id")) & (F.col("key.text_hash") == F.col("kept_key.text_hash"))
    return rows.join(kept, same, "left_semi").select("row.*")
