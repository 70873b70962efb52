"""Text functions on clauses: sentences, counts, headings, model replies, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of sentence splitting.
PREFIXES = "Mr St Mrs Ms Dr".split()
SUFFIXES = "Inc Ltd Jr Sr Co".split()
STARTERS = "Mr Mrs Ms Dr Prof Capt Cpt Lt He She It They Their Our We But However That This Wherever".split()
DOMAINS = "com net org io gov edu me".split()
#: Headings that say nothing.
GENERIC = ["TOC", "REQUIREMENT", "OBJECTIVE", "SCOPE", "TERM"]
#: Words that tell a clause's type.
TYPE_WORDS = {"r": "shall", "o": "objective", "s": "scope"}
#: References to clauses in running text, to standards of any number and of five digits.
REFERENCE = r"[A-Z]+\s+\d{4,5}-?\d*:\d{4}\s+[1-9A-Z][0-9.]*"
STRICT_REFERENCE = r"[A-Z]+\s+\d{5}-?\d*:\d{4}\s+[1-9A-Z][0-9.]*"

_STARTS = "|".join(STARTERS)
#: A dot that ends no sentence: one expression of look-arounds instead of marking and unmarking.
_INNER_DOT = "|".join(
    [
        rf"(?<=(?:{'|'.join(PREFIXES)}))\.",
        rf"\.(?={'|'.join(DOMAINS)})",
        r"(?<=[0-9])\.(?=[0-9])",
        r"(?<=\bPh)\.(?=D\.)|(?<=\bPh\.D)\.",
        r"(?<=[A-Za-z])\.(?=[A-Za-z]\.)",
        rf"(?<=\.[A-Za-z])\.(?! (?:{_STARTS}))",
        r"(?<=\s[A-Za-z])\.",
        rf"(?<=\s(?:{'|'.join(SUFFIXES)}))\.(?! (?:{_STARTS}))",
    ]
)
#: Closing quotes stay with the sentence they close.
_END = rf"(?:\.{{2,}}|(?!{_INNER_DOT})\.|[?!])[\"”]?"
_STOP = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed, in order. Null for null; no sentence for a blank text."""
    flat = F.concat(F.lit(" "), F.replace(text, F.lit("\n"), F.lit(" ")))
    marked = F.regexp_replace(flat, f"({_END})", f"$1{_STOP}")
    return F.filter(F.transform(F.split(marked, _STOP), lambda s: F.trim(s)), lambda s: s != "")


def joined(lines: Column) -> Column:
    return F.trim(F.array_join(lines, " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")).cast("long")


def type_findings(text: Column, kind: Column) -> Column:
    """Types whose word a text holds although the clause has another type."""
    return F.filter(
        F.array(*[F.when(text.rlike(f"(?i){word}") & ~F.lower(kind).eqNullSafe(F.lit(t)), F.lit(t)) for t, word in TYPE_WORDS.items()]),
        lambda x: x.isNotNull(),
    )


# --- headings: display string, alternatives array<struct<heading, status, source>> in order of arrival --------------
def is_generic(heading: Column) -> Column:
    return heading.isin(GENERIC)


def distinct_alternatives(alternatives: Column) -> Column:
    """The first of each heading text, in order."""
    return F.filter(
        alternatives,
        lambda x, i: (i == 0) | ~F.exists(F.slice(alternatives, F.lit(1), i), lambda y: y["heading"] == x["heading"]),
    )


def display_heading(display: Column, alternatives: Column) -> Column:
    """A parsed heading takes the place of a generic display."""
    parsed = F.filter(alternatives, lambda x: x["status"] == "parsed")
    return F.when(is_generic(display) & (F.size(parsed) > 0), F.get(parsed, F.lit(0))["heading"]).otherwise(display)


def is_specific(display: Column, alternatives: Column) -> Column:
    return (display != "") & ~(is_generic(display) & (F.size(alternatives) == 0))


def best_heading(display: Column, alternatives: Column) -> Column:
    """A display that says something, else the first selected heading, else the last generated one, else the display."""
    of = lambda status: F.filter(alternatives, lambda x: x["status"] == status)
    return F.when(~is_generic(display), display).otherwise(
        F.coalesce(F.get(of("selected"), F.lit(0))["heading"], F.try_element_at(of("generated"), F.lit(-1))["heading"], display)
    )


def heading_state(display: Column, alternatives: Column) -> Column:
    has = lambda status: F.exists(alternatives, lambda x: x["status"] == status)
    return (
        F.when(~is_generic(display), F.when(has("parsed"), F.lit("parsed")).otherwise(F.lit("loaded")))
        .when(has("selected"), F.lit("best selected")).when(has("generated"), F.lit("best generated")).otherwise(F.lit("loaded"))
    )


# --- model replies --------------------------------------------------------------------------------------------------
#: The forms in which models list headings in their replies (group 1 is kept).
QUOTED, NUMBERED = r'^[^"]*"(.+)"\W?$', r"^[1-9]\.\s+\*+([\w\s.&-/]+)\*+"
#: Form by model; models that are not listed reply in numbered form. Our own extractive generator gives bare lines.
REPLY_LINES = {"llama3.1": QUOTED, "nemotron": NUMBERED, "granite3-moe": QUOTED, "granite3-dense": QUOTED, "hf.co/ibm-granite/granite-8b-code-instruct-4k-GGUF": QUOTED, "extractive": r"^(?:\d+\.\s+)?(.+)$"}
#: Lines of replies that are no part of a summary, by model.
REPLY_SKIP = REPLY_LINES | {"llama3.1": r".*summary.*", "extractive": r"^\s*summary:?\s*$"}


def reply_headings(reply: Column, model: str = "extractive") -> Column:
    pattern = REPLY_LINES.get(model, NUMBERED)
    return F.filter(F.transform(F.split(reply, "\n"), lambda s: F.trim(F.regexp_extract(F.trim(s), pattern, 1))), lambda s: s != "")


def trimmed_reply(reply: Column, model: str = "extractive") -> Column:
    """Lines of a reply without those that the model's form skips, and without blank lines at either end."""
    lines = F.filter(F.split(reply, "\n"), lambda s: ~s.rlike(rf"(?i)\A(?:{REPLY_SKIP.get(model, NUMBERED).removeprefix('^')})"))
    used = F.filter(F.transform(lines, lambda s, i: F.when(F.trim(s) != "", i)), lambda i: i.isNotNull())
    return F.when(F.size(used) == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.array_min(used) + 1, F.array_max(used) - F.array_min(used) + 1))


def references(line: Column, strict: bool = False) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({STRICT_REFERENCE if strict else REFERENCE})"), 1)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
