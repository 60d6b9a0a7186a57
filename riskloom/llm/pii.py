"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Only column expressions.  Patterns are written so that Java's matcher neither backtracks over long runs nor
recurses: runs are possessive, and a run is entered at its start or where the match before it ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let

#: Characters on each side of a span that are searched for context words.
NEAR = 40
#: Added spans below this score are not reported; the base kinds always are.
LEAST_SCORE = 0.6
#: Spans of a running sum that are added one by one.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """What `pattern` proposes where `hint` may hold, `confirm` checks, and words near it make likelier or less likely."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    score: float
    likelier: str
    unlikelier: str = ""
    base: bool = True


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits of a match have a valid Luhn check digit."""

    def total(ds: Column) -> Column:
        def add(so_far: Column, i: Column) -> Column:
            digit = F.substr(ds, i, F.lit(1)).cast("int")
            twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
            return so_far + F.when((F.length(ds) - i) % 2 == 1, twice).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.length(ds)), F.lit(0), add) % 10 == 0

    return let(digits(found), total)


def mod97(found: Column) -> Column:
    """Whether an account number leaves 1 after the ISO 7064 rule: first four characters last, letters as 10 to 35."""

    def remainder(s: Column) -> Column:
        moved = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

        def add(rest: Column, char: Column) -> Column:
            number = F.when(char.between("0", "9"), F.ascii(char) - 48).otherwise(F.ascii(char) - 55)
            return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

        return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1

    return let(F.replace(found, F.lit(" "), F.lit("")), remainder)


def small_parts(found: Column) -> Column:
    """Whether every part of a dotted quad is at most 255, leading zeros aside."""

    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.when(bare == "", "0").otherwise(F.left(bare, F.lit(3))).cast("int") <= 255)

    return F.forall(F.split(found, r"\."), small)


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def no_check(found: Column) -> Column:
    return F.lit(True)


LETTER_OR_DIGIT = "[A-Za-z0-9]"

KINDS = (
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")), no_check, 0.8, "e-?mail|contact|write|mailto|reply",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda t: t.rlike(r"[0-9]\.[0-9]"), small_parts, 0.6, "ip|host|server|address|login|client", "version|release|section|chapter",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?+[0-9])++",
        lambda t: t.rlike("[0-9][ 0-9-]{10}"), lambda m: F.length(digits(m)).between(12, 19) & luhn(m), 0.7, "card|visa|credit|debit|payment|amex|karte|tarjeta|carte", "isbn|order|tracking",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")), lambda m: F.length(digits(m)).between(9, 15), 0.7, "phone|call|tel|mobile|fax|whatsapp|contact",
    ),
    Kind(
        "iban", rf"(?<!{LETTER_OR_DIGIT})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20[A-Z0-9]{{4}}){{2,7}}(?:\x20[A-Z0-9]{{1,3}})?|[A-Z0-9]{{11,30}})(?!{LETTER_OR_DIGIT})",
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"), mod97, 0.8, "iban|account|konto|cuenta|compte|bank|transfer", base=False,
    ),
    Kind(
        "ssn", rf"(?<!{LETTER_OR_DIGIT})(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}(?!{LETTER_OR_DIGIT})",
        lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), no_check, 0.4, "ssn|social|security|taxpayer", base=False,
    ),
)


def running_sums(lengths: Column) -> Column:
    """Before each element, the sum of those before it; in blocks, so that long lists stay far from quadratic."""
    block = F.lit(BLOCK)
    add = lambda a, b: a + b
    zero = F.lit(0)
    blocks = F.transform(F.sequence(zero, F.floor(F.size(lengths) / block).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * block + 1, block), zero, add))
    ends = F.aggregate(blocks, F.array(zero), lambda sums, more: F.array_append(sums, F.element_at(sums, -1) + more))
    place = lambda i: F.floor(i / block).cast("int")
    return let(ends, lambda es: F.transform(lengths, lambda _, i: F.get(es, place(i)) + F.aggregate(F.slice(lengths, place(i) * block + 1, i % block), zero, add)))


def proposals(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind, leftmost and without overlap, with their scores."""

    def spans(found: Column, between: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))

        def near(i: Column) -> Column:
            return F.lower(F.concat(F.right(F.get(between, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(between, i + 1), F.lit(NEAR))))

        def span(m: Column, i: Column, before: Column) -> Column:
            start = before + F.length(F.get(between, i))
            score = F.lit(kind.score) + F.when(near(i).rlike(rf"\b(?:{kind.likelier})"), 0.2).otherwise(0.0)
            if kind.unlikelier:
                score = score - F.when(near(i).rlike(rf"\b(?:{kind.unlikelier})"), 0.3).otherwise(0.0)
            return F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"),
                F.round(score, 2).alias("score"), F.lit(kind.base).alias("base"), kind.confirm(m).alias("good"),
            )

        sums = let(lengths, running_sums)
        return let(sums, lambda before: F.transform(found, lambda m, i: span(m, i, F.get(before, i))))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    proposed = let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, kind.pattern, -1), lambda b: spans(f, b))))
    return F.when(kind.hint(text), proposed)


def personal_spans(text: Column) -> Column:
    """All spans of a text by start, then kind as listed; start and end are code points, the end is outside."""

    def chosen(t: Column) -> Column:
        lists = F.filter(F.array(*(proposals(t, kind, rank) for rank, kind in enumerate(KINDS))), lambda x: x.isNotNull())
        good = F.filter(F.flatten(lists), lambda s: s["good"] & (s["base"] | (s["score"] >= LEAST_SCORE)))
        return F.array_sort(F.transform(good, lambda s: s.dropFields("good")))

    return let(F.coalesce(text, F.lit("")), chosen)


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans and their scores.

    docs needs doc_id and text; other columns are ignored.  A null or empty text has no spans, and the digest is
    that of an empty string.  Repeated rows give repeated rows; an empty table gives none.
    """
    found = docs.select("doc_id", personal_spans(F.col("text")).alias("found"))
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id",
        *(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(listing(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        listing(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def masked(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; a null text stays null.

    Where spans overlap, the first gives the mark and the whole stretch goes.
    """

    def replace(t: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(state: Column, s: Column) -> Column:
            fresh = s["start"] >= state["at"]
            part = F.concat(F.substr(t, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(state["parts"], part)).otherwise(state["parts"]).alias("parts"))

        return F.aggregate(spans, start, step, lambda end: F.concat(F.array_join(end["parts"], ""), F.substr(t, end["at"] + 1)))

    return let(personal_spans(text), lambda spans: F.when(F.size(spans) == 0, text).otherwise(replace(text, spans)))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in `text`; all other columns and all rows stay."""
    return docs.withColumn("text", masked(F.col("text")))
