"""Catalyst expressions over whole texts that several operators share. No Python runs on executors here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of these separate alphanumeric words in lower-cased text.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 64
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def wrapped_words(text: Column) -> Column:
    """The alphanumeric words of a text, each between two spaces of its own: ' a  b  c '. '' for no words (or null)."""
    words = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NOT_ALNUM, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_of(text: Column, what: str) -> Column:
    """How often a literal that cannot overlap itself stands in the text."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what)))) / len(what.encode())).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element the combination of all before it, starting from ``zero``; null for no elements.

    Appending to an array copies it, so the array is cut in pieces of ``PIECE``, and these in pieces again: what is
    appended to stays short, and the work is linear in the elements up to some millions.
    """

    def pieces(of: Column) -> Column:
        return F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(1), F.size(of), F.lit(PIECE)), lambda at: F.slice(of, at, F.lit(PIECE))))

    def totals(of: Column) -> Column:
        return F.transform(of, lambda piece: F.aggregate(piece, zero, combine))

    def before(piece: Column, start: Column) -> Column:
        return F.slice(F.aggregate(piece, F.array(start), lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x))), F.lit(1), F.size(piece))

    def within(of: Column, starts: Column) -> Column:
        return F.flatten(F.transform(of, lambda piece, i: before(piece, F.get(starts, i))))

    def from_small(small: Column) -> Column:
        return let(totals(small), lambda sums: let(pieces(sums), lambda large: let(before(totals(large), zero), lambda starts: let(within(large, starts), lambda own: within(small, own)))))

    return let(values, lambda every: let(pieces(every), from_small))


def find_all(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found), in code points, end exclusive.

    Spark has no function for positions of all matches: the text is cut at the matches, and lengths of the pieces
    between are summed up. The pattern must not match the empty string.
    """

    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, f: F.struct(F.length(gap).alias("gap"), F.length(f).alias("own")))
        span = lambda at, f: F.struct(at["start"].alias("start"), (at["start"] + F.length(f)).alias("end"), f.alias("found"))
        starts = lambda sizes: F.zip_with(running(F.transform(sizes, lambda x: x["gap"] + x["own"]), F.lit(0), lambda a, b: a + b), sizes, lambda at, x: F.struct((at + x["gap"]).alias("start")))
        return F.zip_with(let(lengths, starts), found, span)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>")))
