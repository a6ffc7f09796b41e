"""Figures in text: token grammar, plausible values, numeric parse."""
from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.fold import WS, collapse_spaces, strip
from sourceloom.functions.lets import let, none_if_blank

# The figure grammar.  A figure starts where no letter, digit, dot or comma
# precedes it; it is grouped ("1,200,000.50") or plain, with an optional magnitude and percent.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
NUMBER = rf"(?:{DIGIT}{{1,3}}(?:[.,]{DIGIT}{{3}})+(?:[.,]{DIGIT}+)?|{DIGIT}+(?:[.,]{DIGIT}+)?)"
# (the leading digit is tested before the costlier look-behind)
_FAST = rf"(?=[0-9\x{{80}}-\x{{10ffff}}])(?={DIGIT})"      # ASCII letters fail on one range test
FIGURE = rf"{_FAST}(?<![{WORD}.,]){NUMBER}{WS}?(?:bn|[kKmMbB])?{WS}?%?(?![{WORD}])"
SPACED_GROUPS = (rf"{_FAST}(?<!{DIGIT}){DIGIT}{{1,3}}(?:[ \x{{a0}}\x{{202f}}\x{{2009}}]{DIGIT}{{3}})+"
                 rf"(?!{DIGIT})")
MAGNITUDES = {"k": 1e3, "m": 1e6, "b": 1e9, "bn": 1e9}

FIGURE_TYPE = "struct<display:string,number:string,suffix:string,percent:boolean>"


@functools.lru_cache(maxsize=1)
def _digit_rules() -> tuple[str, str]:
    pairs = [(chr(cp), str(unicodedata.decimal(chr(cp)))) for cp in range(0x80, 0x20000)
             if unicodedata.category(chr(cp)) == "Nd"]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def ascii_digits(col: Column) -> Column:
    src, dst = _digit_rules()
    return F.when(col.rlike(r"^\p{ASCII}*$"), col).otherwise(F.translate(col, src, dst))


def figure_tokens(text: Column) -> Column:
    """Every figure of a text, exactly as matched (trailing space possible)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0))


def display_of(token: Column) -> Column:
    """A figure as listed: trimmed, one space before a detached suffix."""
    return collapse_spaces(strip(token))


def number_of(token: Column) -> Column:
    return ascii_digits(F.regexp_extract(token, rf"^[{DIGIT}.,]+", 0))


def suffix_of(token: Column) -> Column:
    return F.lower(none_if_blank(F.regexp_extract(token, "(bn|[kKmMbB])", 1)))


def is_weak(token: Column) -> Column:
    """A bare single digit: list markers and small counts prove nothing."""
    return token.rlike(rf"^{DIGIT}{WS}*$")


def magnitude(suffix: Column) -> Column:
    return F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in MAGNITUDES.items()], F.lit(1.0))


def six_digit_key(value: Column) -> Column:
    """BIGINT equality key of a non-negative double at six significant digits."""
    def build(v: Column) -> Column:
        exp = F.floor(F.log10(v))
        scaled = F.when(exp <= 5, v * F.pow(F.lit(10.0), 5 - exp)).otherwise(
            v / F.pow(F.lit(10.0), exp - 5))
        return let(F.struct(F.rint(scaled).cast("bigint").alias("m"), exp.alias("e")), carry)

    def carry(p: Column) -> Column:
        over = p["m"] >= 1_000_000
        return (F.when(over, F.lit(100_000).cast("bigint")).otherwise(p["m"]) * 1000
                + F.when(over, p["e"] + 1).otherwise(p["e"]) + 400)

    return let(value, lambda v: F.when(v == 0, F.lit(0).cast("bigint"))
               .when(v > 1e300, F.lit(-1).cast("bigint")).when(v > 0, build(v)))


def plausible_values(number: Column) -> Column:
    """array<double>: every value the written number may stand for."""
    def cast(c: Column) -> Column:
        return c.try_cast("double")

    def one_separator(n: Column, sep: str) -> Column:
        parts = F.split(n, "[" + sep + "]")
        head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        joined = F.replace(n, F.lit(sep), F.lit(""))
        decimal = cast(F.concat(head, F.lit("."), tail))
        return (F.when(F.size(parts) > 2, F.array(cast(joined)))
                .when(F.length(tail) == 3, F.array(cast(joined), decimal))
                .otherwise(F.array(decimal)))

    def expand(n: Column) -> Column:
        last_dot = F.length(n) - F.length(F.substring_index(n, ".", -1))
        last_comma = F.length(n) - F.length(F.substring_index(n, ",", -1))
        dot_decimal = F.replace(n, F.lit(","), F.lit(""))
        comma_decimal = F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        has_dot, has_comma = n.contains("."), n.contains(",")
        return (F.when(has_dot & has_comma,
                       F.array(F.when(last_dot > last_comma, cast(dot_decimal))
                               .otherwise(cast(comma_decimal))))
                .when(has_dot, one_separator(n, "."))
                .when(has_comma, one_separator(n, ","))
                .otherwise(F.array(cast(n))))

    return F.filter(let(number, expand), lambda v: v.isNotNull())


def token_keys(token: Column) -> Column:
    """array<bigint>: six-digit keys of every interpretation of one figure token."""
    def keys(parts: Column) -> Column:
        plain = F.transform(parts["values"], six_digit_key)
        scaled = F.transform(parts["values"], lambda v: six_digit_key(v * magnitude(parts["suffix"])))
        return F.array_distinct(F.when(parts["suffix"].isNull(), plain).otherwise(F.concat(plain, scaled)))

    return let(F.struct(plausible_values(number_of(token)).alias("values"),
                        suffix_of(token).alias("suffix")), keys)


def spaced_group_keys(text: Column) -> Column:
    """Keys of space-grouped thousands ("1 200 000"): evidence side only."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_GROUPS), F.lit(0))
    digits = F.transform(hits, lambda h: F.regexp_replace(ascii_digits(h), r"[^0-9]", ""))
    return F.array_distinct(F.transform(digits, lambda d: six_digit_key(d.try_cast("double"))))


def evidence_keys(text: Column) -> Column:
    """Every value a text can back: figure interpretations and spaced groups."""
    figures = F.flatten(F.transform(F.array_distinct(figure_tokens(text)), token_keys))
    return F.array_distinct(F.concat(figures, spaced_group_keys(text)))


def parse_num(raw: Column) -> Column:
    """Best single numeric value of a cell, NULL when it is not a number."""
    cleaned = strip(F.regexp_replace(
        strip(F.regexp_replace(raw, r"[\x{a0}\x{202f}\x{2009}]", " ")),
        rf"(?i)[€$£%]|(?:usd|eur|gbp)(?![{WORD}])", ""))

    def value(t: Column) -> Column:
        suffix = F.lower(none_if_blank(F.regexp_extract(t, r"(bn|[kKmMbB])$", 1)))
        digits = F.replace(F.regexp_replace(t, r"(?:bn|[kKmMbB])$", ""), F.lit(" "), F.lit(""))
        return let(ascii_digits(digits), lambda d: number(d)) * magnitude(suffix)

    def number(d: Column) -> Column:
        dots = F.length(d) - F.length(F.replace(d, F.lit("."), F.lit("")))
        commas = F.length(d) - F.length(F.replace(d, F.lit(","), F.lit("")))
        no_commas = F.replace(d, F.lit(","), F.lit(""))
        comma_point = F.replace(d, F.lit(","), F.lit("."))
        after_dot = F.length(F.substring_index(d, ".", -1))
        after_comma = F.length(F.substring_index(d, ",", -1))
        text = (F.when((dots > 0) & (commas > 0),
                       F.when(after_dot < after_comma, no_commas).otherwise(
                           F.replace(F.replace(d, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
                .when(dots > 1, F.replace(d, F.lit("."), F.lit("")))
                .when((commas == 1) & (after_comma != 3), comma_point)
                .otherwise(no_commas))
        trimmed = strip(text)
        return F.when(trimmed.rlike(r"^[-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)$"), trimmed.try_cast("double"))

    gate = rf"^[-+]?[{DIGIT}.,\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{2000}}-\x{{200a}}]+(?:[kKmMbB]|bn)?$"
    # plain decimals, alone or before a currency code, the bulk of all cells, need none of the above
    plain = raw.rlike(r"^[-+]?[0-9]+(?:[.][0-9]+)?$")
    money = raw.rlike(r"\A[-+]?[0-9]+(?:[.][0-9]+)? (?:USD|EUR|GBP)\z")
    return F.when(plain, raw.try_cast("double")).when(money, F.substring_index(raw, " ", 1).try_cast("double")).otherwise(
        let(cleaned, lambda t: F.when(t.rlike(gate) & t.rlike(DIGIT), value(t))))
