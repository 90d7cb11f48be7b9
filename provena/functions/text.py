"""Text columns: tokens, hints, pins, directions, references and sentences. All stay in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions.phrases import before_unit, first_of, labelled, let, near, pieces, plain_number

# Identifiers and words that evidence texts use.
DEVICE_ID = r"[A-Z][A-Za-z0-9]*_[A-Z]-L\d{2}-W\d{2}-D\d{3}"
OVER, UNDER = ("exceed", "exceeds", "exceeded", "above", "over"), ("below", "under")
UPPER_NAMES, LOWER_NAMES = ("upper", "high", "maximum"), ("lower", "low", "minimum")
LIMIT_NAME = "limit"
ABOVE_STEMS, BELOW_STEMS = ("exceed", "above", "fail"), ("below", "under", "fail")  # words that begin so
REACH = 35  # characters between the two words of a direction, at most
HIGH_CAUSES, LOW_CAUSES = ("high", "excessive static current"), ("low",)
CURRENT_DEVICE = "the current DUT"

MEASURED_LABELS, LIMIT_LABELS, UNIT = ("measured static current", "measured current"), ("allowed range", "limits", "limit"), "ma"
TESTER_LINE, FAIL_MARK = ("210", "idd_static"), "(f)"


def tokens(text: Column) -> Column:
    """Distinct lower-case words of more than two of a-z, 0-9 and _, device ids left out; null gives an empty array."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), DEVICE_ID, " "))
    return F.filter(F.array_distinct(F.regexp_extract_all(plain, F.lit("([a-z0-9_]+)"), F.lit(1))), lambda x: F.length(x) > 2)


def overlap(a: Column, b: Column) -> Column:
    """Number of shared elements of two arrays."""
    return F.size(F.array_intersect(a, b))


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def literal(text: Column) -> Column:
    """A pattern that matches the text's characters as they are."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _replacement(text: Column) -> Column:
    """A replacement that gives the text's characters as they are."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def bounded(pattern: Column) -> Column:
    """The pattern where no letter, digit, _ or - touches its match."""
    return F.concat(F.lit("(?<![A-Za-z0-9_-])(?:"), pattern, F.lit(")(?![A-Za-z0-9_-])"))


def replace_identifier(text: Column, old: Column, new: Column) -> Column:
    """Replace an identifier where no letter, digit, _ or - touches it; its and the new one's characters are taken literally."""
    return F.regexp_replace(text, bounded(literal(old)), _replacement(new))


def adapt_procedure(text: Column, historical: Column, current: Column) -> Column:
    """A historical procedure told of the current device: the historical one's id, long or short, gives way; unknown where null."""
    short = F.substring_index(historical, "-", -1)
    named = F.when(F.coalesce(current, F.lit("")) == "", CURRENT_DEVICE).otherwise(F.concat(F.lit(f"{CURRENT_DEVICE} ("), current, F.lit(")")))
    return F.regexp_replace(text, bounded(F.concat_ws("|", literal(historical), literal(short))), _replacement(named))


def only_hint(text: Column, pattern: str, group: int = 1) -> Column:
    """The one distinct match, or null where there is none or more than one."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return F.when(F.size(found) == 1, F.get(found, 0))


def is_ambiguous(text: Column, pattern: str, group: int = 1) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))) > 1


def pin_list(text: Column) -> Column:
    """array<struct<name, number>> of NAME : NUMBER entries, over any number of lines: the parts between entries' ends."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"(:\s*\d+)", "$1\u0001"), "\u0001"), lambda x: F.split(F.trim(x), r"\s*:\s*")), lambda x: F.size(x) >= 2)
    name = lambda x: F.regexp_extract(F.get(x, F.size(x) - 2), r"(\w+)$", 1)
    entries = F.transform(parts, lambda x: F.struct(name(x).alias("name"), F.get(x, F.size(x) - 1).try_cast("int").alias("number")))
    return F.filter(entries, lambda p: p["name"].rlike("^[A-Za-z]") & p["number"].isNotNull())


def pin_residue(text: Column) -> Column:
    """What is left of a pin line without its entries; a well-formed line leaves nothing."""
    return F.regexp_replace(text, r"[A-Za-z]\w*\s*:\s*\d+|\s+", "")


def _says(text: Column, moved: tuple[str, ...], names: tuple[str, ...], stems: tuple[str, ...]) -> Column:
    """Whether a word of movement stands before the name of a limit, or a limit's name before the stem of one, close together."""
    return near(text, moved, (*names, LIMIT_NAME), REACH) | near(text, names, (), REACH, stems)


def _measured(text: Column) -> Column:
    """The first current that a text calls measured."""
    return first_of(F.transform(labelled(text, MEASURED_LABELS), lambda r: plain_number(before_unit(r, UNIT))))


def _limits(text: Column) -> Column:
    """The first pair of limits that a text names, as array of two."""

    def pair(rest: Column) -> Column:
        ends = F.transform(F.split(F.translate(before_unit(rest, UNIT), "–", "-"), "-"), plain_number)
        return F.when((F.size(ends) == 2) & ~F.exists(ends, F.isnull), ends)

    return first_of(F.transform(labelled(text, LIMIT_LABELS), pair))


def _tester_line(text: Column) -> Column:
    """Lower limit, value and upper limit of the first line of the static current test that marks its value as failing."""
    number, name = TESTER_LINE

    def told(line: Column) -> Column:
        names = lambda i: (F.get(line, i) == number) & (F.get(line, i + 2) == name) & (F.trim(F.get(line, i + 1)) == "")
        return F.array_join(F.slice(line, F.get(F.filter(F.sequence(F.lit(0), F.size(line) - 1), names), 0) + 4, 1 << 30), "")

    def ordered(cut: Column) -> Column:
        lower = lambda p: F.when(F.endswith(p, F.lit(UNIT)), F.regexp_extract(p, rf"([0-9]+(?:\.[0-9]+)?)\s*{UNIT}$", 1).try_cast("double"))
        value = lambda p: F.when(F.endswith(p, F.lit(FAIL_MARK)), plain_number(before_unit(p, UNIT)))
        three = lambda i: F.array(lower(F.get(cut, i)), value(F.get(cut, i + 1)), plain_number(before_unit(F.get(cut, i + 2), UNIT)))
        return first_of(F.filter(F.transform(F.sequence(F.lit(0), F.size(cut)), three), lambda t: ~F.exists(t, F.isnull)))

    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: F.contains(x, F.lit(name)) & F.contains(x, F.lit(FAIL_MARK)))
    rests = F.transform(F.transform(lines, pieces), told)
    cuts = F.transform(F.filter(rests, lambda x: x.isNotNull()), lambda x: F.transform(F.split(x, "<"), lambda p: F.trim(p)))
    return first_of(F.transform(cuts, ordered))


def read_direction(observation: Column) -> Column:
    """struct<direction, error> of an observation of a current.

    A failing tester line wins over a measured value with limits, that over words. direction is high above the upper
    limit, low below the lower one, and null at or within them, where both or neither of the words speak, or on an
    error: limits where the lower is not below the upper, conflict where words contradict measured values.
    """
    return let(F.lower(F.coalesce(observation, F.lit(""))), _read)  # made once, whatever it is composed of


def _read(text: Column) -> Column:
    said = F.struct(_says(text, OVER, UPPER_NAMES, ABOVE_STEMS).alias("above"), _says(text, UNDER, LOWER_NAMES, BELOW_STEMS).alias("below"))
    return let(F.struct(said.alias("said"), _tester_line(text).alias("line"), _limits(text).alias("limits"), _measured(text).alias("value")), _judged)


def _judged(x: Column) -> Column:
    above, below, line = x["said"]["above"], x["said"]["below"], x["line"]
    told = F.array(F.get(x["limits"], 0), x["value"], F.get(x["limits"], 1))
    side = lambda t: F.when(F.get(t, 1) > F.get(t, 2), "high").when(F.get(t, 1) < F.get(t, 0), "low")
    crossed = lambda t: F.get(t, 0) >= F.get(t, 2)
    has_line, has_told = line.isNotNull(), x["limits"].isNotNull() & x["value"].isNotNull()
    by_words = F.when(above & ~below, "high").when(below & ~above, "low")
    conflict = side(told).isNotNull() & ((above & (side(told) != "high")) | (below & (side(told) != "low")))
    error = F.when(has_line, F.when(crossed(line), "limits")).when(has_told, F.when(crossed(told), "limits").when(conflict, "conflict"))
    direction_ = F.when(has_line, side(line)).when(has_told, side(told)).otherwise(by_words)
    return F.struct(F.when(error.isNull(), direction_).alias("direction"), error.alias("error"))


def direction(observation: Column) -> Column:
    """high, low or null, as read_direction."""
    return read_direction(observation)["direction"]


def cause_direction(causes: Column) -> Column:
    """Direction that the words of a case's causes speak for; null where both or neither do."""
    text = F.lower(F.coalesce(causes, F.lit("")))
    holds = lambda words: F.greatest(*(F.contains(text, F.lit(w)) for w in (*words, words[0])))
    high, low = holds(HIGH_CAUSES), holds(LOW_CAUSES)
    return F.when(high & ~low, "high").when(low & ~high, "low")


def references(text: Column) -> Column:
    """Distinct fact references E1, E2 ... within brackets of one line, in order, whatever else the brackets hold."""
    inside = F.regexp_extract_all(text, F.lit(r"\[([^\]\n]+)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inside, lambda b: F.regexp_extract_all(b, F.lit(r"\b(E\d+)\b"), F.lit(1)))))


def sentences(text: Column) -> Column:
    """Sentences cut after . ! ? before white space and at line ends, blank ones left out."""
    cuts = F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+", "\n")
    return F.filter(F.transform(F.split(cuts, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def escape_markers(text: Column) -> Column:
    """Put a zero-width space inside chat control markers, so that a text cannot open a turn of its own."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\u200b|")), F.lit("|>"), F.lit("|\u200b>"))
