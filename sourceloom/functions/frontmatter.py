"""Frontmatter as a line automaton, in column expressions.

A fold over the lines of the block.  The state holds the entries that are closed, the entry that is open (key, kind, value,
items) and whether a line fitted nowhere.  Kinds: ``empty`` (a key without a value yet), ``plain``, ``double`` and
``single`` quoted, ``flow`` (a bracketed list), ``list`` (one item a line), ``literal`` and ``folded`` (block scalars).
Scalars and lists may run over several lines.  Whatever the grammar does not know (anchors, tags, nested maps at the top,
tabs as indentation) makes the block unreadable; it is never guessed at.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.lets import let

_KEY = r"^([A-Za-z_][A-Za-z0-9_.-]*):(?:[ \t]+(.*?))?[ \t]*$"
_ITEM = r"^( *)-(?:[ ]+(.*?))?[ \t]*$"
_DOUBLE, _SINGLE, _FLOW = r'^"(?:[^"\\]|\\.)*"$', r"^'(?:[^']|'')*'$", r"^\[.*\]$"
_BLOCK = r"^([|>])([+-]?)$"
#: What a plain value cannot begin with, or hold.
_FOREIGN = r"^[{}&*!%@`|>\],?]|^[-:](?: |$)|: |:$"
_NO_ITEMS = "array<string>"
_ENTRY = "struct<k:string,kind:string,v:string,items:array<string>>"


def _uncommented(value: Column) -> Column:
    """Without a comment; quoted values keep their text."""
    return F.when(value.rlike(r"""^["']"""), F.regexp_replace(value, r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')[ \t]+#.*$""", "$1")).otherwise(
        F.regexp_replace(F.regexp_replace(value, r"(?:^|[ \t]+)#.*$", ""), r"[ \t]+$", ""))


def _entry(k: Column, kind: Column, v: Column, items: Column) -> Column:
    return F.struct(k.alias("k"), kind.alias("kind"), v.alias("v"), items.alias("items"))


def _state(done: Column, cur: Column, pad: Column, bad: Column) -> Column:
    return F.struct(done.alias("done"), cur.alias("cur"), pad.cast("int").alias("pad"), bad.alias("bad"))


def _kind(value: Column) -> Column:
    return (F.when(value == "", "empty").when(value.rlike(_BLOCK), F.when(value.startswith("|"), "literal").otherwise("folded"))
            .when(value.startswith("["), "flow").when(value.startswith('"'), "double").when(value.startswith("'"), "single")
            .when(value.rlike(_FOREIGN), "foreign").otherwise("plain"))


def _closed(cur: Column) -> Column:
    """Whether an entry may end here."""
    return (F.when(cur["kind"] == "flow", cur["v"].rlike(_FLOW)).when(cur["kind"] == "double", cur["v"].rlike(_DOUBLE))
            .when(cur["kind"] == "single", cur["v"].rlike(_SINGLE)).when(cur["kind"] == "foreign", F.lit(False)).otherwise(F.lit(True)))


def _push(done: Column, cur: Column) -> Column:
    return F.when(cur["k"] == "", done).otherwise(F.concat(done, F.array(cur)))


def _step(s: Column, line: Column) -> Column:
    cur = s["cur"]
    kind, none = cur["kind"], F.array().cast(_NO_ITEMS)
    blank = line.rlike(r"^[ \t]*(#.*)?$")
    block = kind.isin("literal", "folded")
    indent = F.length(F.regexp_extract(line, "^( *)", 1))
    value = _uncommented(F.regexp_extract(line, _KEY, 2))
    fresh = _entry(F.regexp_extract(line, _KEY, 1), _kind(value), value, none)
    item = _uncommented(F.regexp_extract(line, _ITEM, 2))
    listed = _entry(cur["k"], F.lit("list"), cur["v"], F.concat(cur["items"], F.array(item)))
    last = F.concat(F.get(cur["items"], F.size(cur["items"]) - 1), F.lit("\n"), F.trim(_uncommented(line)))
    deeper = _entry(cur["k"], kind, cur["v"], F.concat(F.slice(cur["items"], F.lit(1), F.size(cur["items"]) - 1), F.array(last)))
    longer = _entry(cur["k"], kind, F.concat(cur["v"], F.lit(" "), F.trim(_uncommented(F.trim(line)))), cur["items"])
    pad = F.when(s["pad"] >= 0, s["pad"]).otherwise(indent)
    text = _entry(cur["k"], kind, F.concat(cur["v"], F.lit("\n"), F.substring(line, pad + 1, F.length(line))), cur["items"])
    same = s["pad"]
    new_key = line.rlike(_KEY)
    return (F.when(block & line.rlike(r"^ *$"), _state(s["done"], _entry(cur["k"], kind, F.concat(cur["v"], F.lit("\n")), cur["items"]), same, s["bad"]))
            .when(block & (indent > 0) & ((s["pad"] < 0) | (indent >= s["pad"])), _state(s["done"], text, pad, s["bad"]))
            .when(blank, _state(s["done"], cur, same, s["bad"]))
            .when(new_key, _state(_push(s["done"], cur), fresh, F.lit(-1), s["bad"] | ~_closed(cur)))
            .when(kind.isin("empty", "list") & line.rlike(_ITEM), _state(s["done"], listed, same, s["bad"] | _kind(item).isin("literal", "folded")))
            .when((kind == "list") & (indent > 0), _state(s["done"], deeper, same, s["bad"]))
            .when(kind.isin("plain", "double", "single", "flow") & (indent > 0), _state(s["done"], longer, same, s["bad"]))
            .otherwise(_state(s["done"], cur, same, F.lit(True))))


def entries(block: Column) -> Column:
    """Struct (done: array of (k, kind, v, items), bad) of the lines between the marks."""
    start = _state(F.array().cast(f"array<{_ENTRY}>"), _entry(F.lit(""), F.lit("none"), F.lit(""), F.array().cast(_NO_ITEMS)), F.lit(-1), F.lit(False))
    return F.aggregate(F.split(block, "\n"), start, _step, lambda s: F.struct(
        _push(s["done"], s["cur"]).alias("done"), (s["bad"] | ~_closed(s["cur"])).alias("bad")))


def find(done: Column, key: str) -> Column:
    """The entry of a key; of several the last one holds."""
    return F.element_at(F.concat(F.array(F.lit(None).cast(_ENTRY)), F.filter(done, lambda e: e["k"] == key)), -1)


def unquoted(value: Column) -> Column:
    """Text of one scalar as it stands on a line."""
    plain = F.regexp_extract(value, r'(?s)^"(.*)"$', 1)
    # a doubled backslash must not begin another escape
    plain = F.replace(plain, F.lit("\\\\"), F.lit("\x00"))
    for escaped, char in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\x00", "\\")):
        plain = F.replace(plain, F.lit(escaped), F.lit(char))
    single = F.replace(F.regexp_extract(value, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(value.startswith('"'), plain).when(value.startswith("'"), single).otherwise(value)


def _folded(v: Column) -> Column:
    """Lines joined by blanks; an empty line is a line break."""
    return F.regexp_replace(F.regexp_replace(v, r"([^\n])\n(?=[^\n])", "$1 "), r"\n(\n+)", "$1")


def scalar_text(entry: Column) -> Column:
    """Text of a scalar entry; null for lists and where there is no entry."""
    mark, kind = F.regexp_extract(entry["v"], r"^[|>]([+-]?)", 1), entry["kind"]
    body = F.regexp_replace(entry["v"], r"^[|>][+-]?\n?", "")
    body = F.when(kind == "folded", F.concat(_folded(F.regexp_replace(body, r"\n+$", "")), F.regexp_extract(body, r"(\n*)$", 1))).otherwise(body)
    bare = F.regexp_replace(body, r"\n+$", "")
    chomped = F.when(mark == "+", F.concat(body, F.lit("\n"))).when((mark == "-") | (bare == ""), bare).otherwise(F.concat(bare, F.lit("\n")))
    nothing = F.when(entry["v"].isin("~", "null", "Null", "NULL"), "").otherwise(entry["v"])
    return (F.when(kind.isin("literal", "folded"), chomped).when(kind.isin("double", "single"), unquoted(entry["v"]))
            .when(kind == "plain", nothing).when(kind == "empty", F.lit("")))


def raw_items(entry: Column) -> Column:
    """Items of a bracketed or a line list as they are written; null for anything else."""
    inner = F.regexp_extract(entry["v"], r"(?s)^\[(.*)\]$", 1)
    parts = F.regexp_extract_all(inner, F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|\{[^}]*\}|[^,\s][^,]*)"""), F.lit(1))
    return F.when(entry["kind"] == "flow", F.transform(parts, lambda p: F.trim(p))).when(entry["kind"] == "list", entry["items"])


def items(entry: Column) -> Column:
    return F.transform(raw_items(entry), unquoted)


def item_fields(entry: Column, field: str) -> Column:
    """One field of each item that is a map, on one line ({ name: x, type: y }) or on several."""
    scalar = r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|{0})"""
    found = F.transform(raw_items(entry), lambda i: F.when(i.startswith("{"), F.regexp_extract(
        i, rf"(?:^\{{|,)\s*{field}:\s+" + scalar.replace("{0}", r"[^,}]*?") + r"\s*(?:,|\}$)", 1)).otherwise(
        F.regexp_extract(i, rf"(?m)^{field}:[ \t]+" + scalar.replace("{0}", r".*?") + r"[ \t]*$", 1)))
    return F.transform(F.filter(found, lambda x: x != ""), unquoted)


def split(text: Column) -> Column:
    """Struct (block, done, bad) of a page that begins with a block; block is '' where there is none."""
    return let(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1), lambda b: let(entries(b), lambda e: F.struct(
        b.alias("block"), e["done"].alias("done"), e["bad"].alias("bad"))))
