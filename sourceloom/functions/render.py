"""Text rendering of pages as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: Column) -> Column:
    """Double-quoted scalar; control characters escaped."""
    s = value
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " "), F.lit('"'))


# a scalar may stay unquoted only if no reader could take it for a number, date, boolean or null
_PLAIN = r"^[A-Za-z][\p{L}\p{N}_.\-/]*(?: [\p{L}\p{N}_.\-/]+)*$"
_WORDS_WITH_MEANING = r"(?i)^(?:y|yes|n|no|on|off|true|false|null|nan|inf|[eE]\d+)$"


def scalar(value: Column) -> Column:
    safe = value.rlike(_PLAIN) & ~value.rlike(_WORDS_WITH_MEANING)
    return F.when(safe, value).otherwise(quoted(value))


def field(name: str, value: Column) -> Column:
    """``name: value`` or NULL, so that ``concat_ws`` skips absent fields."""
    return F.concat(F.lit(f"{name}: "), value)


def inline_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, scalar), ", "), F.lit("]"))


def table(rows: Column) -> Column:
    """Markdown table of array<array<string>>; the first row is the header."""
    def cell(c: Column) -> Column:
        return F.trim(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))

    def line(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), body), "\n")
