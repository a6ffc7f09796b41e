"""Claims anchored by bitmaps against comparing every claim with every window."""
import random
import re

from sourceloom.functions.words import split_claims
from sourceloom.operators import claims

_STOP = {"the", "and", "for", "with", "that", "this", "from", "was", "were", "are", "our", "their", "has", "have", "had", "will", "would",
         "into", "over", "under", "about"}


def tokens(text):
    return {t for t in re.findall("[a-z0-9]{3,}", text.lower()) if t not in _STOP}


def plain(claim, source):
    want, best = tokens(claim), (0, 0.0)
    if want and source:
        for start in range(0, max(1, len(source) - claims.WINDOW_CHARS // 2), claims.WINDOW_STEP):
            score = len(want & tokens(source[start:start + claims.WINDOW_CHARS])) / len(want)
            if score > best[1]:
                best = (start, score)
    return best


def test_best_window():
    r = random.Random(2)
    assert claims.best_window([]) == (0, 0) and claims.best_window([0, 0]) == (0, 0)
    for _ in range(300):
        maps = [r.getrandbits(12) for _ in range(r.randint(1, 9))]
        counts = [sum(m >> w & 1 for m in maps) for w in range(12)]
        assert claims.best_window(maps) == ((counts.index(max(counts)), max(counts)) if max(counts) else (0, 0))


def test_anchors_match_plain(spark):
    r = random.Random(9)
    words = [f"word{i}" for i in range(60)] + ["the", "and", "ab"]
    rows = []
    for i in range(25):
        source = " ".join(r.choice(words) for _ in range(r.choice([0, 5, 200, 900])))
        body = "\n\n".join(" ".join(r.choice(words) for _ in range(r.randint(5, 30))) for _ in range(r.randint(0, 5)))
        rows.append((i, source if i % 7 else None, body))
    rows.append((99, "x", "the and the and the and the and the and the and the and"))
    df = spark.createDataFrame(rows, "doc int, source string, body string")
    got = {}
    for x in claims.anchor_claims(df, ["doc"]).collect():
        got.setdefault(x["doc"], []).append((x["claim_no"], x["claim"], x["start"], round(x["score"], 9)))
    want = {}
    for i, source, body in rows:
        kept = [b for b in (re.sub(r"\s+", " ", x).strip() for x in body.split("\n\n")) if len(b) >= 40]
        for n, c in enumerate(kept):
            start, score = plain(c, source or "")
            want.setdefault(i, []).append((n, c, start, round(score, 9)))
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 10


def test_window_words_match_windows_read_one_by_one():
    """Runs cut by the edges of windows, runs longer than a window, letters whose lower case is longer or plain."""
    r = random.Random(4)
    sources = ["", "ab", "x" * 5000, "a" * 299 + " " + "b" * 301, "İ" * 700 + "abİcd " * 300, "Kelvin \u212aELVIN é" * 200]
    sources += ["".join(r.choice("ab  zİ\u212aé9") for _ in range(r.choice([299, 300, 301, 601, 2500]))) for _ in range(60)]
    sources += ["".join(r.choice(["q" * r.randint(1, 1500), " "]) for _ in range(12)) for _ in range(40)]
    for source in sources:
        windows = [set(re.findall("[a-z0-9]{3,}", source[s:s + claims.WINDOW_CHARS].lower()))
                   for s in range(0, max(1, len(source) - claims.WINDOW_CHARS // 2), claims.WINDOW_STEP)]
        spoken = set().union(*windows, ["never said"])
        want = {w: sum(1 << k for k, held in enumerate(windows) if w in held) for w in spoken}
        assert claims.window_words(source, spoken) == {w: bits for w, bits in want.items() if bits}
        assert claims.window_words(source, set()) == {}


def test_pages_are_split_once(spark):
    """A filter on the claims would be pushed below them and split every page a second time."""
    plan = claims.anchor_claims(spark.range(3).selectExpr("id", "string(id) AS body", "'x' AS source"), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_audit_names_what_cannot_be_checked(spark):
    claim = "revenue of the northern branch grew because of orders for copper wire"
    state = spark.createDataFrame([("a", "p/a", "processed"), ("b", "p/b", "processed"), ("c", "p/c", "processed"), ("d", None, "processed"),
                                   ("e", "p/e", "deleted"), ("f", "p/f", "processed")], "file_id string, path string, status string")
    pages = spark.createDataFrame([("p/a", claim + "\n\nan unrelated statement about gardens, roofs and stairs"), ("p/c", claim), ("p/e", claim), ("p/f", "short")],
                                  "path string, body string")
    sources = spark.createDataFrame([("a", "In May " + claim + "."), ("b", "x"), ("f", "y")], "file_id string, text string")
    got = {r["file_id"]: (r["outcome"], r["checked"], r["unsupported"]) for r in claims.audit_claims(state, pages, sources).collect()}
    assert got == {"a": ("checked", 2, 1), "b": ("page missing", 0, 0), "c": ("source missing", 0, 0), "d": ("no page on record", 0, 0),
                   "e": ("no page on record", 0, 0), "f": ("checked", 0, 0)}


def test_claims_are_tidied_as_before(column):
    """Only blocks with loose white space are rewritten; all others come through as they are."""
    spaces = [*map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000])]
    texts = ["", " ", "a b", " a b", "a b ", "a  b", "“a — b”", f"é{chr(0x200b)}ü 漢字{chr(0x1f600)}"]
    texts += [t for c in spaces for t in (f"a{c}b", f"{c}a b", f"a b{c}", f"a {c}b", f"“a” {c}{c} b", f"a b{c}\n\n{c}c  d")]
    want = [[" ".join(b.split()) for b in re.split(r"\n\s*\n", t) if b.split()] for t in texts]
    assert column(lambda t: split_claims(t, min_chars=1), texts) == want


def test_audit_counts_claims_where_page_and_source_meet(spark):
    """Two joins bring body and source to the document's row; they are not made again to add the counts."""
    text = spark.range(3).selectExpr("string(id) AS file_id", "string(id) AS path", "'processed' AS status", "'x' AS body", "'y' AS text")
    plan = claims.audit_claims(text, text, text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("MapInArrow") == 1 and "Aggregate" not in plan


def test_audit_counts_as_claim_by_claim(spark):
    r = random.Random(6)
    words = [f"word{i}" for i in range(80)] + ["the", "and", "ab"]
    rows = []
    for i in range(40):
        source = " ".join(r.choice(words[:50]) for _ in range(r.choice([0, 5, 200, 900])))
        body = "\n\n".join(" ".join(r.choice(words) for _ in range(r.randint(5, 30))) for _ in range(r.randint(0, 5)))
        rows.append((str(i), f"p/{i}", "processed", body, source))
    rows.append(("none", "p/none", "processed", "the and the and the and the and the and the and the and", "x"))
    df = spark.createDataFrame(rows, "file_id string, path string, status string, body string, text string")
    judged = claims.judge_claims(claims.anchor_claims(df, ["file_id"], source="text"))
    want = {k: (0, 0) for k, *_ in rows}
    for x in judged.collect():
        n, bad = want[x["file_id"]]
        want[x["file_id"]] = (n + 1, bad + (x["verdict"] == "unsupported"))
    got = {x["file_id"]: (x["checked"], x["unsupported"]) for x in claims.audit_claims(df, df, df).collect()}
    assert got == want and got["none"] == (1, 0) and len(set(want.values())) > 5
