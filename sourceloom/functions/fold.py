"""Accent folding and slugs as JVM expressions.

Spark has no Unicode ``normalize``; the mappings below are *derived by rule* from the Unicode
database when the module is imported and shipped to the plan as literals, so folding runs inside
the JVM and needs no Python worker.
"""
from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.lets import let

_PLANE_LIMIT = 0x30000          # no character from here on has a decomposition


def _ascii_of(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()


@functools.lru_cache(maxsize=1)
def _ascii_rules() -> tuple[str, str, dict[str, str]]:
    """(one-to-one sources, their targets, one-to-many expansions) for NFKD + ASCII."""
    src, dst, many = [], [], {}
    for cp in range(0x80, _PLANE_LIMIT):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        out = _ascii_of(chr(cp))
        if len(out) == 1:
            src.append(chr(cp))
            dst.append(out)
        elif out:
            many[chr(cp)] = out
    return "".join(src), "".join(dst), many


@functools.lru_cache(maxsize=1)
def _accent_rules() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks."""
    src, dst = [], []
    for cp in range(0x80, _PLANE_LIMIT):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


@functools.lru_cache(maxsize=1)
def _single_mark_latin_rules() -> tuple[str, str]:
    """Latin letters carrying exactly one diacritic: the full-text tokenizer folds only these."""
    src, dst = [], []
    for cp in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() \
                and unicodedata.category(parts[1]) == "Mn":
            src.append(chr(cp))
            dst.append(parts[0].lower())
    return "".join(src), "".join(dst)


def _char_class(chars) -> str:
    """Character class with consecutive code points joined into ranges."""
    points, out = sorted(ord(c) for c in chars), []
    start = prev = points[0]
    for cp in [*points[1:], None]:
        if cp is not None and cp == prev + 1:
            prev = cp
            continue
        out.append(f"\\x{{{start:x}}}" + (f"-\\x{{{prev:x}}}" if prev > start else ""))
        start = prev = cp
    return "[" + "".join(out) + "]"


# anything beyond ASCII and the ordinary Latin letters may need a one-to-many expansion
_UNUSUAL = r"[^\x00-\x7F\x{c0}-\x{131}\x{134}-\x{17f}]"


def ascii_fold(col: Column) -> Column:
    """NFKD, then drop everything that is not ASCII."""
    src, dst, many = _ascii_rules()
    expansions = F.from_json(F.lit(_as_json(many)), "map<string,string>")

    def expand(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_char_class(many)), F.lit(0)))
        return F.aggregate(found, text, lambda acc, ch: F.replace(acc, ch, F.try_element_at(expansions, ch)))

    def fold(text: Column) -> Column:
        plain = F.when(text.rlike(_UNUSUAL), expand(text)).otherwise(text)
        return F.regexp_replace(F.translate(plain, src, dst), r"[^\x00-\x7F]", "")

    # the all-ASCII case is by far the most frequent and skips the character walk
    return let(col, lambda text: F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(fold(text)))


def _as_json(mapping: dict[str, str]) -> str:
    import json
    return json.dumps(mapping)


def strip_accents(col: Column) -> Column:
    """Canonical decomposition with the combining marks removed."""
    src, dst = _accent_rules()
    return let(col, lambda t: F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(
        F.regexp_replace(F.translate(t, src, dst), r"\p{Mn}+", "")))


def path_norm(col: Column) -> Column:
    return strip_accents(F.lower(col))


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, WS_RUN, " ")


# The whitespace set of the text layer (Unicode spaces included), for Java regular expressions.
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_RUN = WS + "+"


_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
             + "\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_WS_CHARS))


# any of the set but the plain blank; and what is neither a blank nor a common letter, which a scan tells much sooner
_OTHER_WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNCOMMON = r"[^ -~\x{a1}-\x{167f}]"


def tidy(col: Column) -> Column:
    """``strip(collapse_spaces(col))`` of a bound value (a lambda's): only texts whose spaces are not yet so are rewritten."""
    loose = col.contains("  ") | col.startswith(" ") | col.endswith(" ") | (col.rlike(_UNCOMMON) & col.rlike(_OTHER_WS))
    return F.when(loose, strip(collapse_spaces(col))).otherwise(col)


def slug(col: Column) -> Column:
    """Lower-case ASCII words joined by single hyphens."""
    dashed = F.regexp_replace(ascii_fold(col), "[^a-zA-Z0-9]+", "-")
    return F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))


def node_slug(col: Column) -> Column:
    """Slug of a graph node: at most 60 characters, never empty."""
    cut = F.substring(slug(col), 1, 60)
    return F.when(cut == "", F.lit("x")).otherwise(cut)


def plain_norm(col: Column) -> Column:
    """Folded, lower-cased, whitespace collapsed (mention look-up text)."""
    return collapse_spaces(F.lower(ascii_fold(col)))


def cell_norm(col: Column) -> Column:
    """Comparison form of a spreadsheet cell: compatibility composed, trimmed, lower."""
    return collapse_spaces(F.lower(strip(let(col, lambda t: F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(_compatible(t))))))


@functools.lru_cache(maxsize=1)
def _compat_rules() -> tuple[str, str, dict[str, str]]:
    """(one-to-one sources, their targets, one-to-many expansions) for compatibility composition."""
    src, dst, many = [], [], {}
    for cp in range(0x80, _PLANE_LIMIT):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        out = unicodedata.normalize("NFKC", ch)
        if len(out) > 1:
            many[ch] = out
        elif out != ch:
            src.append(ch)
            dst.append(out)
    return "".join(src), "".join(dst), many


@functools.lru_cache(maxsize=1)
def _composed_pairs() -> dict[str, str]:
    """Base character and combining mark -> the one character they compose to."""
    pairs = {}
    for cp in range(0xC0, _PLANE_LIMIT):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", pair) == chr(cp):
                pairs[pair] = chr(cp)
    return pairs


def _replaced(text: Column, found: Column, mapping: dict[str, str]) -> Column:
    table = F.from_json(F.lit(_as_json(mapping)), "map<string,string>")
    return F.aggregate(F.array_distinct(found), text, lambda acc, x: F.replace(acc, x, F.coalesce(F.try_element_at(table, x), x)))


def _compatible(text: Column) -> Column:
    src, dst, many = _compat_rules()

    def compose(t: Column) -> Column:
        return F.when(t.rlike(r"\p{M}"), _replaced(t, F.regexp_extract_all(t, F.lit(r"\P{M}\p{M}"), F.lit(0)), _composed_pairs())).otherwise(t)

    # up to three marks follow one base letter in composed alphabets
    spread = F.when(text.rlike(_UNUSUAL), _replaced(text, F.regexp_extract_all(text, F.lit(_char_class(many)), F.lit(0)), many)).otherwise(text)
    return let(F.translate(spread, src, dst), lambda a: let(compose(a), lambda b: let(compose(b), compose)))


def search_fold(col: Column) -> Column:
    """Lower-case and remove the single diacritics the full-text tokenizer ignores."""
    src, dst = _single_mark_latin_rules()
    return let(F.lower(col), lambda t: F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(
        F.regexp_replace(F.translate(t, src, dst), r"\p{Mn}+", "")))
