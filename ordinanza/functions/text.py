"""Text helpers with Python's notion of white space and digits, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split and str.strip treat as white space; valid in Java and in RE2.
SPACE = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SECTION_INLINE = r"(\d{1,2}\.\d{1,2}\.\d{1,3})"
SECTION_LINE = r"^(\d+\.\d+\.\d+)"
SECTION_REF = r"\b(\d+\.\d+\.\d+(?:\.\d+)*)\b"


def strip(c: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """Python's str.split(): no empty tokens."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True where any phrase is a substring; the text is not lower-cased here."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def first_match(text: Column, groups, value) -> Column:
    """value(payload) of the first group with a phrase in the text, else null."""
    out = None
    for phrases, payload in groups:
        test = contains_any(text, phrases)
        out = F.when(test, value(payload)) if out is None else out.when(test, value(payload))
    return out


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def preview(c: Column, width: int) -> Column:
    """The text, cut to ``width`` characters plus three dots where it is longer."""
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)


def highlight(c: Column, on: str = "[", off: str = "]") -> Column:
    """Mark every 'Section N.N.N' reference, whatever its case."""
    return F.regexp_replace(c, r"(?i)\b(Section\s+\d+\.\d+\.\d+(?:\.\d+)*)\b", f"{on}$1{off}")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[0-9;]*m", "")


def wrap(c: Column, width: int) -> Column:
    """Greedy word wrap: an array of lines, none longer than ``width`` unless one word is.

    Every word counts one more than its letters, but for the word that begins a
    new line; so the first line holds one character less than the others.
    """
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0).alias("used"))

    def step(acc, word):
        used = acc["used"] + F.length(word) + 1
        fits = used <= width
        return F.struct(
            F.when(fits | (acc["line"] == ""), acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))).alias("lines"),
            F.when(fits & (acc["line"] != ""), F.concat_ws(" ", acc["line"], word)).otherwise(word).alias("line"),
            F.when(fits, used).otherwise(F.length(word)).alias("used"),
        )

    return F.aggregate(
        tokens(c), start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"])))
    )


def clock(c: Column) -> Column:
    """Time of day as HH:mm:ss, in the session's time zone."""
    return F.date_format(c, "HH:mm:ss")
