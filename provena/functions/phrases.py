"""What a text says, read from its tokens: phrases, words close to each other, and quantities beside their labels."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OF_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?<={_OF_WORD})(?!{_OF_WORD})|(?<!{_OF_WORD})(?={_OF_WORD})"
_END = 1 << 30
_MARK = "\u0001"  # stands for a label while a text is cut


def strings(words: Iterable[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def pieces(line: Column) -> Column:
    """A line's words and what stands between them, in order."""
    return F.split(line, _EDGE)


def token_line(text: Column) -> Column:
    """Lower-case words and single marks with one space between them and at both ends."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"({_OF_WORD}+)|(\S)", " $1$2 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(apart, r"\s+", " ")), F.lit(" "))


def holds(tokens: Column, phrases: Iterable[str]) -> Column:
    """Whether a token line holds one of the phrases, each of tokens with one space between."""
    wanted = strings(f" {p} " for p in phrases)
    return let(tokens, lambda line: F.exists(wanted, lambda p: F.contains(line, p)))


def parts_after(text: Column, cut: Column) -> Column:
    """What follows each place of a text where another one stands, up to the next such place."""
    return F.slice(F.split(text, F.concat(F.lit(r"\Q"), cut, F.lit(r"\E"))), 2, _END)


def leads_to(tokens: Column, leads: Iterable[str], tails: Iterable[str]) -> Column:
    """Whether in a token line one of the tails begins right behind one of the leads."""
    begins, ends = strings(f" {x} " for x in leads), strings(tails)
    follows = lambda line, x: F.exists(parts_after(line, x), lambda rest: F.exists(ends, lambda e: F.startswith(rest, e)))
    # A line is made once, and cut by those leads alone that it holds.
    return let(tokens, lambda line: F.exists(begins, lambda x: F.contains(line, x) & follows(line, x)))


def near(text: Column, first: Iterable[str], second: Iterable[str], reach: int, stems: Iterable[str] = ()) -> Column:
    """Whether on a line a word of first is followed, after at most reach characters, by one of second or one that begins with a stem."""
    begins, named, wanted = strings(first), strings(second), strings(stems)

    def follows(after: Column) -> Column:
        start = F.struct(F.lit(0).alias("gap"), F.lit(False).alias("hit"))
        meets = lambda p: F.array_contains(named, p) | F.exists(wanted, lambda s: F.startswith(p, s))
        walk = lambda a, p: F.struct((a["gap"] + F.length(p)).alias("gap"), (a["hit"] | ((a["gap"] <= reach) & meets(p))).alias("hit"))
        return F.aggregate(after, start, walk, lambda a: a["hit"])

    def says(line: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(line) - 1), lambda i: F.array_contains(begins, F.get(line, i)) & follows(F.slice(line, i + 2, reach + 1)))

    def of(lower: Column) -> Column:
        both = any_of(lower, first) & any_of(lower, (*second, *stems))  # cheap, and few texts pass it
        return F.when(both, F.exists(F.transform(F.split(lower, "\n"), pieces), says)).otherwise(F.lit(False))

    return let(F.lower(text), of)


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words, anywhere."""
    return functools.reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def plain_number(text: Column) -> Column:
    """A text that is one number of digits, with or without a fraction, and white space."""
    x = F.trim(text)
    digits = F.regexp_replace(x, "[0-9]", "")
    return F.when(digits.isin("", ".") & ~x.startswith(".") & ~x.endswith(".") & (x != ""), x.try_cast("double"))


def before_unit(text: Column, unit: str) -> Column:
    """What stands before a unit's first mention; null where it is not named."""
    return F.when(F.contains(text, F.lit(unit)), F.substring_index(text, unit, 1))


def labelled(text: Column, labels: Iterable[str]) -> Column:
    """What follows each label and its colon, in order, up to the next label; labels in lower case, longer ones first."""
    names = tuple(labels)

    def rests(lower: Column) -> Column:
        marked = F.translate(lower, _MARK, " ")
        for label in names:
            marked = F.replace(marked, F.lit(label), F.lit(_MARK))
        found = F.transform(parts_after(marked, F.lit(_MARK)), lambda r: F.regexp_replace(r, r"^\s+", ""))
        colons = F.transform(F.filter(found, lambda r: F.startswith(r, F.lit(":"))), lambda r: F.substring(r, F.lit(2), F.length(r)))
        return F.when(any_of(lower, names) | lower.isNull(), colons).otherwise(strings(()))

    return let(F.lower(text), rests)


def first_of(values: Column) -> Column:
    """The first element that is not null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)
