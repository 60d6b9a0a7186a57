"""Quality rules with thresholds that adapt to language and source.

Every rule is a ratio of two counts of a text, in whole thousandths.  A group's sketch of a ratio is its
histogram over these thousandths: sketches of parts merge by adding counts, the order does not matter, and
a quantile read from one is off by less than one thousandth.  A group with few documents takes the merged
sketch of its language, a language with few documents that of all.  A document is rejected where a ratio
lies beyond the fence of its group: quartile plus or minus `reach` times the group's spread.  The spread is the
middle half of the ratio or, where that is narrower, what one event (a symbol, a line, a repeated window) adds to the
ratio in the group's short texts: the UNIT_PERCENT quantile of a second sketch, so that no group rejects a text for
a single event and no constant decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import let, small_side, stored, words

SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\x0b\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: With fewer usable documents a group takes the sketch of the next larger one.
GROUP_DOCUMENTS = 200
#: The quantile of the ratio that one event makes which counts as the short texts' resolution.
UNIT_PERCENT = 95
#: With fewer usable documents in all, that quantile is the largest value itself, and there is no fence.
LEAST_DOCUMENTS = 100 // (100 - UNIT_PERCENT)
#: Up to so many repeated windows each window is looked up in their list; beyond, windows are sorted.
LISTED = 16

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`name` = `top` in 1000 parts of `below`; spreads to the fence; what one event adds to `top`; the sides on which a document can fail."""

    name: str
    top: str
    below: str
    reach: float
    event: int
    high: bool = True
    low: bool = False


RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", 5, 1),
    Rule("dup_line_share", "n_dup_lines", "n_lines", 1, 1),
    Rule("repeat_share", "n_repeat_words", "n_words", 4, 6),
    Rule("word_length", "word_chars", "n_words", 4, 0, True, True),
)


def repeated_words(ws: Column) -> Column:
    """How many words lie in a three-word window that the text holds at least twice.

    Windows are compared by a 64-bit hash; in a text of a million words two different windows share one
    with a chance below 1e-7.
    """

    def covered(hashes: Column) -> Column:
        def count(positions: Column) -> Column:
            steps = F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1), p + 3) - p))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

        def listed(doubles: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda p: F.array_contains(doubles, F.get(hashes, p)))

        def ranked() -> Column:
            pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
            twins = lambda s: F.filter(
                s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) & (i > 0) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
            )
            return let(pairs, lambda s: F.array_sort(F.transform(twins(s), lambda x: x["p"])))

        def doubled(s: Column) -> Column:
            return F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))

        def by_doubles(doubles: Column) -> Column:
            return F.when(F.size(doubles) <= LISTED, let(listed(doubles), count)).otherwise(let(ranked(), count))

        single = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(single, F.lit(0).cast("long")).otherwise(let(let(F.sort_array(hashes), doubled), by_doubles))

    starts = F.sequence(F.lit(0), F.size(ws) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) < 3, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def text_counts(text: Column) -> Column:
    """A struct of the counts of one text; null counts as a text without words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)

    def counts(ws: Column, ls: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    return let(words(text), lambda ws: let(lines, lambda ls: counts(ws, ls)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def thousandths(rule: Rule) -> Column:
    return F.when(F.col(rule.below) > 0, F.floor(1000 * F.col(rule.top) / F.col(rule.below)).cast("long"))


def unit_of(name: str) -> str:
    """The name of the sketch of what one event adds to a ratio."""
    return f"{name} unit"


def one_event(rule: Rule) -> Column:
    return F.when(F.col(rule.below) > 0, F.floor(F.lit(1000 * rule.event) / F.col(rule.below)).cast("long"))


def sketches(counted: DataFrame, groups: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per group, rule (or a rule's unit) and thousandth with its number of documents: a sketch that merges by adding."""
    usable = counted.filter(~base_failed())
    named = [(r.name, thousandths(r)) for r in rules] + [(unit_of(r.name), one_event(r)) for r in rules if r.event]
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), value.alias("value")) for name, value in named)))
    return usable.select(*groups, values.alias("x")).select(*groups, "x.*").filter("value IS NOT NULL").groupBy(*groups, "rule", "value").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Quartiles and UNIT_PERCENT quantile (nearest rank) of each group and rule, and its number of documents."""
    part = Window.partitionBy(*groups, "rule")
    ranked = sketch.withColumn("upto", F.sum("n").over(part.orderBy("value"))).withColumn("total", F.sum("n").over(part))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("value")))
    return ranked.groupBy(*groups, "rule").agg(at(25).alias("q1"), at(75).alias("q3"), at(UNIT_PERCENT).alias("top"), F.max("total").alias("documents"))


def fences(counted: DataFrame, rules: Sequence[Rule] = RULES, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """The lowest and highest allowed value of every rule per (lang, source), one row per group.

    Larger groups are merged from the sketches of the smaller ones, not counted again.
    """
    per_source = stored(sketches(counted, ["lang", "source"], rules), "sketch")
    per_lang = per_source.groupBy("lang", "rule", "value").agg(F.sum("n").alias("n"))
    overall = per_lang.groupBy("rule", "value").agg(F.sum("n").alias("n"))
    names = per_source.select("lang", "source").distinct().withColumn("rule", F.explode(F.array(*(F.lit(n) for r in rules for n in (r.name, unit_of(r.name))))))
    own = quartiles(per_source, ["lang", "source"])
    lang = quartiles(per_lang, ["lang"])
    every = quartiles(overall, [])

    def renamed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))

    joined = (
        names.join(renamed(own, "own"), F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")) & (F.col("rule") == F.col("own_rule")), "left")
        .join(renamed(lang, "lang"), F.col("lang").eqNullSafe(F.col("lang_lang")) & (F.col("rule") == F.col("lang_rule")), "left")
        .join(renamed(every, "all"), F.col("rule") == F.col("all_rule"), "left")
    )
    enough = lambda side: F.coalesce(F.col(f"{side}_documents"), F.lit(0)) >= group_documents
    pick = lambda q: F.when(enough("own"), F.col(f"own_{q}")).when(enough("lang"), F.col(f"lang_{q}")).when(F.col("all_documents") >= LEAST_DOCUMENTS, F.col(f"all_{q}"))
    picked = joined.select("lang", "source", "rule", *(pick(q).alias(q) for q in ("q1", "q3", "top")))
    one = lambda rule, q: F.max(F.when(F.col("rule") == rule, F.col(q)))
    limits = []
    for r in rules:
        q1, q3, unit = one(r.name, "q1"), one(r.name, "q3"), F.coalesce(one(unit_of(r.name), "top"), F.lit(0))
        away = r.reach * F.greatest(q3 - q1, unit, F.lit(1))
        limits += [(q1 - away).alias(f"{r.name}_low"), (q3 + away).alias(f"{r.name}_high")]
    return picked.groupBy("lang", "source").agg(*limits)


def within(rules: Sequence[Rule] = RULES) -> Column:
    """True where no ratio lies beyond its fence; a ratio without a denominator cannot fail."""
    checks = []
    for r in rules:
        value = thousandths(r)
        if r.high:
            checks.append(F.coalesce(value <= F.col(f"{r.name}_high"), F.lit(True)))
        if r.low:
            checks.append(F.coalesce(value >= F.col(f"{r.name}_low"), F.lit(True)))
    return reduce(Column.__and__, checks)


def judged(counted: DataFrame, rules: Sequence[Rule] = RULES, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Add `base_failed` and `kept` to stored rows with lang, source and the counts."""
    limits = small_side(stored(fences(counted, rules, group_documents), "fences"))
    limits = limits.withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    same = F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source"))
    return counted.join(limits, same, "left").withColumns({"base_failed": base_failed()}).withColumn("kept", ~F.col("base_failed") & within(rules))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document, stored; other columns are left out."""
    return stored(docs.select("doc_id", "lang", "source", text_counts(F.col("text")).alias("c")).select("doc_id", "lang", "source", "c.*"), "quality")


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Counts and verdict of every document.

    docs needs doc_id, text, lang, source; other columns are ignored.  A null or empty text has no words and
    fails the base rules.  Null languages and sources are groups of their own.  A repeated row gives a repeated
    row, and an empty table gives no rows.
    """
    verdict = judged(measured(docs), rules, group_documents)
    return verdict.select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """The documents that pass, with their own columns, whatever these are called."""
    counted = docs.select(F.struct("*").alias("row"), text_counts(F.col("text")).alias("c"))
    wide = stored(counted.select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), "c.*"), "quality")
    return judged(wide, rules, group_documents).filter("kept").select("row.*")
