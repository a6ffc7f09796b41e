"""The frontmatter automaton on blocks of all kinds."""
import pytest
from pyspark.sql import functions as F

from sourceloom.functions import frontmatter as fm
from sourceloom.operators.pages import parse_pages

BLOCK = """title: "A \\"quoted\\" title: with \\\\n" # a comment
plain: two words   # another
single: 'it''s: fine'
number: 12
nothing: ~
empty:
inline: [a, "b, c", 'd''e', {name: x}]
wide: [one,
  two, "three"]
items:
- first
- "second # not a comment"
# a comment line
indented:
    - alpha   # gone
    - beta

mentions:
  - { name: "Globex, Inc.", type: company }
  - name: Zed
    type: person
  - type: other
    name: 'O''Hara'
folded: >-
  one line
  goes on

  after a break
literal: |
  first
    kept
  last
kept: |+
  x

long: words that
  go on
  here
plain: wins""".split("\n")


def read(spark, lines):
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    return df.select(fm.entries(F.col("t")).alias("e")).select("e.done", "e.bad")


def test_kinds(spark):
    df = read(spark, BLOCK)
    names = ["title", "plain", "single", "number", "nothing", "empty", "folded", "literal", "kept", "long", "absent", "items"]
    row = df.select("bad", *[fm.scalar_text(fm.find(F.col("done"), n)).alias(n) for n in names],
                    *[fm.items(fm.find(F.col("done"), n)).alias("l_" + n) for n in ("inline", "wide", "items", "indented", "title")],
                    fm.item_fields(fm.find(F.col("done"), "mentions"), "name").alias("who"),
                    fm.item_fields(fm.find(F.col("done"), "mentions"), "type").alias("what")).first().asDict()
    assert row == {
        "bad": False, "title": 'A "quoted" title: with \\n', "plain": "wins", "single": "it's: fine", "number": "12", "nothing": "", "empty": "",
        "folded": "one line goes on\nafter a break", "literal": "first\n  kept\nlast\n", "kept": "x\n\n", "long": "words that go on here",
        "absent": None, "items": None, "l_inline": ["a", "b, c", "d'e", "{name: x}"], "l_wide": ["one", "two", "three"],
        "l_items": ["first", "second # not a comment"], "l_indented": ["alpha", "beta"], "l_title": None,
        "who": ["Globex, Inc.", "Zed", "O'Hara"], "what": ["company", "person", "other"]}


@pytest.mark.parametrize("lines", [
    ["a: [1, 2", "b: x"], ['a: "open', "b: x"], ["a: &anchor x"], ["a: {b: c}"], ["no key here"], ["a: x", "- item"], ["a: b: c"], ["\ta: x"],
    ["  indented: first"], ["a: 'open", "b: 'x'"], ["a:", "  b: nested"]])
def test_unreadable_blocks(spark, lines):
    assert read(spark, lines).first()["bad"]


def test_pages(spark):
    texts = {
        "list": "---\ntitle: T\nacl:\n  - sales\n  - 'eng'\ntags:\n- x\n- y\n---\nbody\n",
        "typed": "---\nacl:\n  - 010\n---\nb", "quoted": '---\nacl: ["010"]\n---\nb', "bad": "---\ntitle: [x\n---\nb",
        "folded": "---\ntitle: >\n  long\n  title\nmentions:\n  - name: Globex\n    type: company\n---\n", "none": "---\nno end", "crlf": "--- \r\nacl: [a]\n"}
    df = spark.createDataFrame([(k, t, 1.0, 1) for k, t in texts.items()], "path string, text string, mtime double, size long")
    got = {r["path"]: (r["title"], r["acl"], r["tags"], r["mentions"], r["body"]) for r in parse_pages(df).collect()}
    assert got["list"] == ("T", ["sales", "eng"], "x y", "", "body\n")
    assert got["typed"][1] == [] and got["quoted"][1] == ["010"] and got["bad"][1] == [] and got["none"][1] == [] and got["crlf"][1] == []
    assert got["folded"] == ("long title\n", None, "", "Globex", "") and got["bad"][4] == texts["bad"]
