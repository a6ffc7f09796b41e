import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sourceloom.functions.access import visible
from sourceloom.operators import changes, curation, facts, graph, naming, ownership, search, versions
from sourceloom.operators.naming import close_pairs
from sourceloom.operators.pages import annotate_field, parse_pages


def test_classification_order_and_accents(spark):
    paths = ["./A/KPI NDA.md", "./A/Réunion Minutes.txt", "./A/site.css", "./root.md", "./A/spec v1.md", "./A/unknown.bin", "root2.md"]
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, size long")
    got = {r["path"]: (r["type"], r["verdict"]) for r in curation.classify(df).collect()}
    assert got == {"./A/KPI NDA.md": ("reports", "IN"), "./A/Réunion Minutes.txt": ("meeting-minutes", "IN"),
                   "./A/site.css": ("web-assets", "OUT"), "./A/spec v1.md": ("product-docs", "IN"), "./A/unknown.bin": ("other", "MAYBE")}


def test_canonical_copy_survives_trim_and_empty_files_stay(spark):
    rows = [("./A/x copy.md", "reports", "IN", "A", "h", 5), ("./A/b/x.md", "reports", "IN", "A", "h", 5),
            ("./A/x.png", "reports", "IN", "A", "h", 5), ("./A/e1.md", "memos", "IN", "A", "e", 0), ("./A/e2.md", "memos", "IN", "A", "e", 0)]
    df = spark.createDataFrame(rows, "path string, type string, verdict string, unit string, hash string, size long")
    assert sorted(r["path"] for r in curation.curate(df).collect()) == ["./A/b/x.md", "./A/e1.md", "./A/e2.md"]


def test_entities_from_paths(spark):
    paths = ["Portfolio/2024/3. Acme - archived/board/m.pdf", "Clients/1. Legal/x.pdf", "Pipeline/Evaluating/Beta Co (lost)/deck.pdf",
             "Misc/Acme/notes.md", "Clients/2. report.pdf", "Accounts EU/4 - Gamma - on-hold/q.md", "Q1 2025/Acme/2023 x.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: (r["entity"] and (r["entity"]["slug"], r["entity"]["kind"], r["entity"]["seq"], r["entity"]["status"])) for r in
           ownership.resolve_entities(df).collect()}
    assert got[paths[0]] == ("acme", "tracked", 3, "archived") and got[paths[1]] is None
    assert got[paths[2]] == ("beta-co", "prospect", None, "lost") and got[paths[3]][:2] == ("acme", "tracked")
    assert got[paths[4]] is None and got[paths[5]] == ("gamma", "tracked", 4, "on-hold")
    last = ownership.resolve_entities(df).filter(F.col("path") == paths[6]).first()
    assert (last["path_date"], last["path_period"]) == ("2025", "2025-Q1")


def test_visibility_truth_table(spark):
    acls = [None, [], ["a"], ["a", "b"], ["ab"]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(acls)], "i int, acl array<string>")
    for scope in (None, set(), {"a"}, {"b"}, {"c"}):
        got = {r["i"] for r in df.filter(visible(F.col("acl"), scope)).collect()}
        assert got == {i for i, a in enumerate(acls) if a is None or scope is None or set(a) & scope}


def test_shared_audience_is_the_intersection(spark):
    rows = [("x", ["a", "b"]), ("x", ["b", "c"]), ("x", None), ("y", None), ("z", ["a"]), ("z", ["b"]), ("w", [])]
    df = spark.createDataFrame(rows, "g string, acl array<string>")
    assert {r["g"]: r["acl"] for r in ownership.shared_audience(df, "g").collect()} == {"x": ["b"], "y": None, "z": [], "w": []}


def test_scope_applies_before_the_limit(spark):
    rows = [("f", f"p{i}", "e", None, "m", "m", "1", 1.0, None, "2026-01", None, f"r{i:03d}", "t", 1, "secret" if i < 60 else None) for i in range(65)]
    store = spark.createDataFrame(rows, "file_id string, page_path string, entity string, org_unit string, metric string, metric_raw string, "
                                  "value_raw string, value_num double, unit string, period string, dimension string, source_ref string, "
                                  "extracted_at string, verified int, acl string")
    assert facts.query_facts(store, metric="m", limit=50, audiences={"x"}).count() == 5
    assert facts.query_facts(store.drop("acl"), metric="m", audiences={"x"}).count() == 0
    gone = spark.createDataFrame([(f"p{i}",) for i in range(64)], "path string")
    assert [r["source_ref"] for r in facts.query_facts(store, limit=3, exclude_pages=gone).collect()] == ["r064"]


def test_quotes(spark):
    rows = [("a  b", "x a b y", 2), ("a b", "x a\n b y", 2), ("zz", "x", -1), ("$5 (net)", "was $5 (net) ok", 4)]
    df = spark.createDataFrame([r[:2] for r in rows], "q string, s string").coalesce(1)
    assert [r[0] for r in df.select(facts.quote_offset(F.col("q"), F.col("s"))).collect()] == [r[2] for r in rows]


def test_merge_candidates_lose_no_containment(spark):
    keys = ["globex", "globex foods", "globex bank", "acme", "acme corp europe", "europe", "foods globex", "zeta"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r["a"], r["b"]) for r in graph.merge_candidates(df, with_ratio=False).collect()}
    brute = {tuple(sorted(p)) for p in itertools.combinations(keys, 2)
             if set(p[0].split()) <= set(p[1].split()) or set(p[1].split()) <= set(p[0].split())}
    assert got == brute


def blocks(a, b):
    """Characters in matching blocks: the longest common block, earliest in a, then in b; then both sides of it."""
    best = (0, 0, 0)
    ends = {}
    for i, x in enumerate(a):
        now = {}
        for j, y in enumerate(b):
            if x == y:
                k = now[j] = ends.get(j - 1, 0) + 1
                if k > best[2]:
                    best = (i - k + 1, j - k + 1, k)
        ends = now
    i, j, k = best
    return k and k + blocks(a[:i], b[:j]) + blocks(a[i + k:], b[j + k:])


def plain_ratio(a, b):
    return 2 * blocks(a, b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("threshold", [0.55, 0.75])
def test_close_names_match_brute_force(spark, threshold):
    r = random.Random(4)
    names = {"acme quarterly report", "acme quarterly report corrected", "globex plan", "globex plans", "q", "", "zz"}
    while len(names) < 90:
        names.add("".join(r.choice("abcde ") for _ in range(r.randint(1, 14))).strip())
    rows = [(g, n) for n in names for g in ("g", "h" if len(n) % 2 else None)]
    got = {(r.grp, r.a, r.b) for r in close_pairs(spark.createDataFrame(rows, "grp string, stem string"), "stem", ["grp"], threshold).collect()}
    scopes = {}
    for g, n in rows:
        scopes.setdefault(g, set()).add(n)
    assert got == {(g, *sorted(p)) for g, own in scopes.items() for p in itertools.combinations(own, 2) if "" not in p and plain_ratio(*sorted(p)) >= threshold}


def moved_names(seed, count):
    """Names of few words, with copies whose blocks are moved, cut or spelled otherwise."""
    r = random.Random(seed)
    syllables = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in ("", "n", "r", "x")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    names = set()
    while len(names) < count:
        parts = [word() for _ in range(r.randint(2, 4))]
        names.add(" ".join(parts))
        if r.random() < 0.3:
            k = r.randrange(1, len(parts))
            names.add(" ".join(parts[k:] + parts[:k] + [word()] * r.randint(0, 1)))
        if r.random() < 0.2:
            names.add(" ".join(parts)[r.randint(1, 3):])
    return sorted(names)[:count]


@pytest.mark.parametrize(("threshold", "hot"), [(0.55, 8), (0.75, 2), (0.75, 10_000)])
def test_names_with_moved_blocks(spark, threshold, hot):
    """Divided buckets give what whole ones do, and both give what all pairs give."""
    names = moved_names(7, 500)
    want = set()
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            match = difflib.SequenceMatcher(None, a, b)
            if match.real_quick_ratio() >= threshold and match.quick_ratio() >= threshold and match.ratio() >= threshold:
                want.add((a, b, round(match.ratio(), 9)))
    df = spark.createDataFrame([(n,) for n in names], "key string")
    got = {(r["a"], r["b"], round(r["ratio"], 9)) for r in close_pairs(df, "key", [], threshold, hot=hot).collect()}
    assert got == want and len(want) > 60


def test_five_thousand_names(spark):
    """Every planted move is found and every pair found is true; all pairs of one letter are compared with brute force."""
    names = moved_names(8, 5_000)
    df = spark.createDataFrame([(n,) for n in names], "key string")
    got = {(r["a"], r["b"]): r["ratio"] for r in close_pairs(df, "key", [], 0.75).collect()}
    assert all(abs(difflib.SequenceMatcher(None, a, b).ratio() - v) < 1e-12 and v >= 0.75 for (a, b), v in got.items())
    some = [n for n in names if n < "bo"]
    for a in some:
        for b in names:
            if a < b:
                match = difflib.SequenceMatcher(None, a, b)
                if match.real_quick_ratio() >= 0.75 and match.quick_ratio() >= 0.75 and match.ratio() >= 0.75:
                    assert (a, b) in got
    assert len(some) > 100 and len(got) > 800


def test_common_subsequence_bounds_the_blocks():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 25))) for _ in range(2))
        assert naming.common_subsequence(a, b) >= blocks(a, b)
        assert (naming.block_ratio(a, b) if a or b else 1.0) == pytest.approx(plain_ratio(a, b))
    assert naming.block_ratio("acme sales report", "sales report europe", 0.55) == pytest.approx(24 / 36)


def test_no_name_is_too_common_to_be_compared(spark):
    names = [f"{w} report" for w in ("zulu", "zuly")] + [f"x{i:05d}y report" for i in range(1_100)]
    df = spark.createDataFrame([(n,) for n in names], "key string")
    got = {(r["a"], r["b"]) for r in graph.merge_candidates(df.filter("key like 'zul%' or key like '%00_y %'")).collect()}
    assert ("zulu report", "zuly report") in got
    every = {(r["a"], r["b"]) for r in close_pairs(df, "key", [], 0.9).filter("a like 'zul%'").collect()}
    assert every == {("zulu report", "zuly report")}


def test_versions_link_to_the_newest_similar_one(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [("1", "plan v1.md", "2026-01", text), ("2", "plan v2.md", "2026-02", text + " more"), ("3", "plan FINAL.md", "2026-03", other),
            ("4", "plan v2 (1).md", "2026-02", text), ("5", "roadmap.md", "2026-01", text)]
    docs = spark.createDataFrame([(i, n, "e", "", d, t) for i, n, d, t in rows], "file_id string, name string, entity string, unit string, as_of string, text string")
    got = {(r["old_id"], r["new_id"]) for r in versions.detect_versions(docs, similar_names=False).collect()}
    assert got == {("1", "2"), ("4", "2")}


DOC = "file_id string, name string, entity string, unit string, as_of string, text string"
NO_LINKS = "grp string, old_id string, new_id string, similarity double"


def test_versions_between_families(spark):
    """All members of families with similar names meet, not only their heads; the newest by rank wins, not the largest id."""
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [("1", "acme sales report v1.md", "2026-01", text), ("9", "acme sales report v3.md", "2026-03", other),
            ("2", "sales report europe v2.md", "2026-02", text + " more"), ("3", "sales report europe v4.md", "2026-02", text + " more words"),
            ("8", "holiday list v9.md", "2026-09", text), ("7", "sales report europe v2 (1).md", "2026-02", text)]
    docs = spark.createDataFrame([(i, n, "e", "", d, t) for i, n, d, t in rows], DOC)
    got = {(r["old_id"], r["new_id"]) for r in versions.detect_versions(docs).collect()}
    assert got == {("1", "3"), ("2", "3"), ("7", "3")}


def test_links_are_withdrawn_with_their_reason(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))

    def docs(*rows):
        return spark.createDataFrame([(i, n, e, "", d, t) for i, n, e, d, t in rows], DOC)

    def pairs(links):
        return {(r["old_id"], r["new_id"]) for r in links.collect()}

    a1, a2, a3 = ("1", "plan v1.md", "e", "", text), ("2", "plan v2.md", "e", "", text), ("3", "plan v3.md", "e", "", text)
    b1, b2 = ("4", "memo v1.md", "f", "", text), ("5", "memo v2.md", "f", "", text)
    first = docs(a1, a2, b1, b2)
    links = versions.update_links(spark.createDataFrame([], NO_LINKS), first, versions.touched_groups(first.limit(0), first, first))
    assert pairs(links) == {("1", "2"), ("4", "5")}
    rewritten = docs(a1, ("2", "plan v2.md", "e", "", other), b1, b2)
    links = versions.update_links(links, rewritten, versions.touched_groups(first, rewritten, rewritten.filter("file_id = '2'")))
    assert pairs(links) == {("4", "5")}
    newest = docs(a1, a2, a3, b1)                                       # one is back, one is new, one is gone
    links = versions.update_links(links, newest, versions.touched_groups(rewritten, newest, docs(a2, a3, b2)))
    assert pairs(links) == {("1", "3"), ("2", "3")}
    assert {r["file_id"]: (r["superseded_by"], r["supersedes"]) for r in versions.marks(links, newest).collect()} == {
        "1": ("3", None), "2": ("3", None), "3": (None, "2")}
    moved = docs(a1, a2, ("3", "plan v3.md", "f", "", text), b1)        # into the other group
    links = versions.update_links(links, moved, versions.touched_groups(newest, moved, docs(a3)))
    assert pairs(links) == {("1", "2")}


def test_slug_numbers_of_very_many_collisions(spark):
    rows = [(f"k{i:05d}", "s/x") for i in range(3_000)] + [(f"n{u}", f"s/x-{u}") for u in (2, 3, 7, 2_999)]
    got = {r["key"]: r["slug"] for r in graph.unique_slugs(spark.createDataFrame(rows, "key string, base string")).collect()}
    free = [n for n in range(2, 4_000) if n not in (2, 3, 7, 2_999)]
    assert got["k00000"] == "s/x" and [got[f"k{i:05d}"] for i in range(1, 3_000)] == [f"s/x-{n}" for n in free[:2_999]]


def test_slug_collisions_skip_real_slugs(spark):
    df = spark.createDataFrame([("a b", "s/a-b"), ("a-b", "s/a-b"), ("a b 2", "s/a-b-2"), ("c", "s/c")], "key string, base string")
    got = {r["key"]: r["slug"] for r in graph.unique_slugs(df).collect()}
    assert got == {"a b": "s/a-b", "a-b": "s/a-b-3", "a b 2": "s/a-b-2", "c": "s/c"}


def test_phrases_need_adjacent_words_in_one_column(spark):
    pages = spark.createDataFrame([("p1", "arr usd", "x"), ("p2", "arr", "usd"), ("p3", "usd arr usd", "")], "path string, title string, body string")
    phrases = spark.createDataFrame([("arr usd",)], "phrase string")
    got = {(r["path"], r["f"]) for r in search.phrase_hits(phrases, search.build_postings(pages)).collect()}
    assert got == {("p1", 1), ("p3", 1)}


def test_changes(spark):
    inv = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", None), ("d", "h1"), ("e", "h9")], "file_id string, raw_hash string")
    state = spark.createDataFrame([("b", "old", "processed", None), ("c", "h3", "processed", None), ("d", "h1", "duplicate", "gone"),
                                   ("e", "h9", "processed", None), ("x", "h5", "processed", None), ("y", "h6", "deleted", None)],
                                  "file_id string, raw_hash string, status string, duplicate_of string")
    pending = changes.pending_changes(inv, state)
    assert {r["file_id"]: r["reason"] for r in pending.collect()} == {"a": "new", "b": "changed", "d": "changed", "x": "deleted"}
    canon = {r["file_id"]: r["canonical_id"] for r in changes.elect_canonical(pending, state, inv).collect()}
    assert canon == {"a": "a", "b": "b", "d": "a", "x": "x"}


def test_unreadable_acl_reaches_nobody(spark):
    texts = ["---\ntitle: A\nacl: [finance, sales]\n---\nbody", "---\ntitle: A\n---\nbody", "plain", "---\nacl: finance\n---\nb",
             "---\nacl: [a\nno end", "---\nacl: [010]\n---\nb", "﻿---\nacl: [x]\n---\nb", "---\nacl: []\n---\nb"]
    df = spark.createDataFrame([(str(i), t, 1.0, 1) for i, t in enumerate(texts)], "path string, text string, mtime double, size long")
    got = {r["path"]: r["acl"] for r in parse_pages(df).collect()}
    assert got == {"0": ["finance", "sales"], "1": None, "2": None, "3": [], "4": [], "5": [], "6": ["x"], "7": []}


def test_annotation_replaces_a_field(spark):
    md = "---\ntitle: A\nsuperseded_by: old\n---\n\nbody\n"
    df = spark.createDataFrame([(md, '"new"')], "m string, v string")
    out = df.select(annotate_field(F.col("m"), "superseded_by", F.col("v"))).first()[0]
    assert out == '---\ntitle: A\nsuperseded_by: "new"\n---\n\nbody\n'
