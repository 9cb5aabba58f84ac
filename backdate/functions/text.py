"""Text columns: fallbacks, sentence truncation, list and number rendering."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separator control characters.
_SPACE = r"[\s\x1c-\x1f]"


def first_filled(*columns: Column) -> Column:
    """First value that is neither NULL nor empty; the last one is the default."""
    *tried, default = columns
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in tried], default)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def first_sentences(text: Column, n: int) -> Column:
    """The first ``n`` sentences, joined by one space and stripped.

    A sentence ends at ``.``, ``!`` or ``?`` before white space. Splitting stops
    once they are found, so a long text costs no more than its first sentences.
    """
    sentences = F.split(text, rf"(?U)(?<=[.!?]){_SPACE}+", n + 1)
    return strip(F.array_join(F.slice(sentences, 1, n), " "))


def plain_number(value: Column, digits: int) -> Column:
    """A rounded double without exponent or padding zeros; NULL reads ``None``."""
    fixed = value.cast(f"decimal(38,{digits})").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
    return F.coalesce(trimmed, F.lit("None"))


def json_number(value: Column) -> Column:
    """A double as JSON: written out from 0.0001 up to 1e16, else with an exponent; NULL reads ``null``."""
    shown = value.cast("string")
    mantissa, exponent = F.substring_index(shown, "E", 1), F.substring_index(shown, "E", -1).try_cast("int")
    digits = F.regexp_replace(shown.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    short = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""), F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    size = F.abs(value)
    text = F.when(~F.contains(shown, F.lit("E")), shown).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)
    return F.coalesce(text, F.lit("null"))


def _each_letter(text: Column, odd: str, shown: Callable[[Column], Column]) -> Column:
    """The text with each character that matches ``odd`` replaced by what ``shown`` makes of it."""
    swapped = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(odd), shown(c)).otherwise(c))
    return F.when(text.rlike(odd), F.array_join(swapped, "")).otherwise(text)


def _swapped(text: Column, swaps: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), swaps, text)


def json_string(text: Column) -> Column:
    """A JSON string in ASCII; NULL reads ``null``."""
    known = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")]

    def units(c: Column) -> Column:
        code = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.regexp_replace(code, "([0-9a-f]{4})", r"\\u$1")

    inside = _each_letter(_swapped(text, known), r"[^\x20-\x7e]", units)
    return F.coalesce(F.concat(F.lit('"'), inside, F.lit('"')), F.lit("null"))


def quoted(text: Column) -> Column:
    """A string literal in single quotes, or in double quotes if it holds only single ones.

    Control, format, private and unassigned characters and all white space but
    the blank are written as escapes.
    """
    swaps = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]

    def code(c: Column) -> Column:
        whole = F.lower(F.hex(F.encode(c, "UTF-32")))
        return (
            F.when(F.startswith(whole, F.lit("000000")), F.concat(F.lit("\\x"), F.right(whole, F.lit(2))))
            .when(F.startswith(whole, F.lit("0000")), F.concat(F.lit("\\u"), F.right(whole, F.lit(4))))
            .otherwise(F.concat(F.lit("\\U"), whole))
        )

    escaped = _each_letter(_swapped(text, swaps), r"[\p{C}\p{Z}&&[^ ]]", code)
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def quoted_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def quoted_map(entries: Column, digits: int = 4) -> Column:
    """A map of names to numbers, in its own order."""
    items = F.transform(
        F.map_entries(entries), lambda e: F.concat(quoted(e["key"]), F.lit(": "), plain_number(e["value"], digits))
    )
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
