"""Exact dedup, packing, mixing, fingerprints, licenses, pages and toxicity against plain restatements."""
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import brute
from sourceloom.llm import exact, html, licenses, mixing, packing, spots, toxicity

CLASH = ["rid", "content", "sha", "span", "nth", "copy", "_n", "sequence_id", "score", "words"]


# ---- exact dedup

def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.BREAK.sub(" ", t or ""), []).append(i)
    return {i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def test_exact_dedup(make_docs, sample_docs):
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "\t"), (1004, "a b"), (1005, "a b"), (1006, "a\r\n b"), (1007, "A b"), (1008, "x" * 300_000)]
    rows = sample_docs + odd
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.digest(make_docs(rows, CLASH)).collect()}
    assert got == brute_exact(rows)


def test_exact_dedup_recurses_until_buckets_fit(make_docs, sample_docs):
    rows = sample_docs[:40]
    found = exact.exact_groups(make_docs(rows), block_bytes=5_000, table_bytes=3_000)
    got = {r.rid: (r.keep, r.group_size, r.kept, r.sha) for r in found.collect()}
    assert got == brute_exact(rows)


def test_exact_dedup_repeated_rows_and_missing_ids(make_docs):
    out = exact.digest(make_docs([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b")])).collect()
    assert sorted((r.text_sha256, str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == sorted(
        [(hashlib.sha256(b"a").hexdigest(), d, "1", 4) for d in ("1", "1", "2", "None")] + [(hashlib.sha256(b"b").hexdigest(), "None", "None", 2)] * 2)
    assert sum(r.kept for r in out) == 2


# ---- packing

def check_packing(rows, pieces, length):
    from tokenizers import Tokenizer
    import public_tokenizers
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id]) and p.length >= 1
    assert by_doc.keys() == ids.keys()
    for i, own_pieces in by_doc.items():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    for own_pieces in by_sequence.values():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return sum(map(len, ids.values())) / (len(by_sequence) * length)


def test_packing_round_trip(make_docs, sample_docs):
    odd = [(5000, None), (5001, ""), (5002, "<|endoftext|> between <|endoftext|>"), (5003, "y" * 20_000), (5004, " " * 9_000),
           (5005, "naïve 日本語 \U0001f600\r\n\t x"), (5006, "ab " * 40_000)]
    rows = sample_docs + odd
    full = check_packing(rows, packing.pack(make_docs(rows, CLASH)).collect(), 2048)
    assert full > 0.97
    check_packing(rows[:60], packing.pack(make_docs(rows[:60]), length=64, keep=2).collect(), 64)


def test_packing_repeats_and_nothing(make_docs):
    out = packing.pack(make_docs([(None, "same"), (None, "same"), (1, "same")])).collect()
    assert len(out) == 3 and {r.sequence_id for r in out} and sorted(str(r.doc_id) for r in out) == ["1", "None", "None"]
    assert packing.pack(make_docs([])).collect() == []


# ---- mixing

def test_poisson_inversion(spark):
    from pyspark.sql import functions as F

    def inverse(mean, u):
        k, term = 0, math.exp(-mean)
        total = term
        while total <= u:
            k += 1
            term *= mean / k
            total += term
        return k
    rows = [(m, u) for m in (0.0, 0.01, 0.5, 1.0, 3.7, 16.0) for u in (0.0, 0.2, 0.5, 0.9, 0.999999)]
    got = spark.createDataFrame(rows, "m double, u double").withColumn("k", mixing.poisson(F.col("m"), F.col("u"))).collect()
    assert [(r.m, r.u, r.k) for r in got] == [(m, u, inverse(m, u)) for m, u in rows]


def test_large_means_are_sums(spark):
    from pyspark.sql import functions as F
    got = [r.k for r in spark.range(400).select(mixing.copies(F.lit(900.0), F.col("id"), 3).alias("k")).collect()]
    assert abs(np.mean(got) - 900) < 6 and 20 < np.std(got) < 40


def test_mixing_matches_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.execute(mixing.SQL).fetchall())
    out = mixing.digest(docs)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 100
    most, mixing.MOST_SOURCES = mixing.MOST_SOURCES, 0
    try:
        assert sorted(map(tuple, mixing.digest(docs).collect())) == want
    finally:
        mixing.MOST_SOURCES = most


def test_mixing_weights_and_odd_rows(make_docs):
    rows = [(i, "x" * 100) for i in range(300)]
    out = mixing.mix(make_docs(rows, ["_source2"]), {"s0": 3.0, "s1": 1.0, "s2": 0.0}).collect()
    count = {s: sum(r.source == s for r in out) for s in ("s0", "s1", "s2")}
    assert count["s2"] == 0 and abs(count["s0"] - 225) < 50 and abs(count["s1"] - 75) < 30
    assert len(mixing.mix(make_docs([(1, None), (2, ""), (None, "a"), (None, "a")])).collect()) >= 0
    assert mixing.mix(make_docs([])).collect() == []


# ---- fingerprints

COMMON = set(spots.COMMON)


def brute_set(text):
    own = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    content = [w for w in own if w not in COMMON]
    out, before = set(), 0
    for i, w in enumerate(own):
        if w in COMMON:
            chain = content[before:before + spots.CHAIN]
            if len(chain) == spots.CHAIN:
                out.add((w, *chain))
        else:
            before += 1
    left = np.cumsum([w not in COMMON for w in own][::-1])[::-1] if own else []
    count = sum(w in COMMON and left[i] >= spots.CHAIN for i, w in enumerate(own))
    if not own:
        return {text}
    return out | set(own) if count < spots.FEW else out


def like(a, b):
    return len(a & b) / len(a | b)


def test_fingerprints_match_brute_force(make_docs, sample_docs):
    rows = sample_docs + [(9000, None), (9001, ""), (9002, "the"), (9003, "!!"), (9004, "a" * 3001), (9005, "the of and"), (9006, "x")]
    got = {r.doc_id: r for r in spots.digest(make_docs(rows, CLASH)).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        other = ordered[(k + 1) % len(ordered)][1]
        h = len(text) // 2
        edited = text[:len(text) - h] + other[:h]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(brute_set(text), brute_set(edited)), abs=1e-9)
        assert r.near_next == pytest.approx(like(brute_set(text), brute_set(other)), abs=1e-9)
    same = {}
    for i, text in ordered:
        same.setdefault(text, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    whole = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in whole]) > 0.95


def test_fingerprint_pairs_match_brute_force(make_docs, sample_docs):
    rows = sample_docs[:120] + [(i + 7000, t.replace("the", "a", 1)) for i, t in sample_docs[:40]]
    members, pairs = spots.near_pairs(make_docs(rows))
    class_of = {r.rid: r.class_id for r in members.collect()}
    sets = {i: frozenset(brute_set(t)) for i, t in rows}
    assert {i: min(j for j in sets if sets[j] == sets[i]) for i in sets} == class_of
    reps = sorted(set(class_of.values()))
    want = {(a, b) for a in reps for b in reps if a < b and like(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_fingerprints_of_repeats_single_and_no_rows(make_docs):
    assert spots.digest(make_docs([])).collect() == []
    one = spots.digest(make_docs([(4, "abcd")])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    assert len(spots.digest(make_docs([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).collect()) == 4


# ---- licenses

def brute_license(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        w = phrase.split()
        hits = [i for i in range(len(own)) if own[i:i + len(w)] == w]
        places += hits
        labels |= {label} if hits else set()
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(make_docs, sample_docs):
    odd = [(8000, None), (8001, ""), (8002, "CC BY! cc-by CC\nBY"), (8003, "MIT license" * 3), (8004, "mit, License; Apache-License"),
           (8005, "über mit license é"), (8006, "Permission is hereby granted, free of charge")]
    rows = sample_docs + odd
    got = {r.doc_id: r for r in licenses.licenses(make_docs(rows, CLASH)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_templates():
    def labels(text):
        return licenses.scan(text, licenses.PHRASES, tuple(licenses.TEMPLATES.items()))[5]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("licensed under the terms of the GNU General Public License, either version 2 of the License") == "gpl,gpl-2.0"
    assert labels("licensed under the old GNU General Public License, version 3.") == "gpl"
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0"
    assert labels("Foo Bar is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                  "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                  "any later version.") == "gpl,gpl-notice"
    assert labels("All rights are reserved. All rights reserved.") == "all-rights-reserved"
    assert labels("GNU Lesser General Public License") == "lgpl"
    own = licenses.Automaton("a <<optional>> b <<optional>> c <<end>> <<end>> d <<var 1 2>> e")
    for text, found in (("a d x e", 1), ("a b d x y e", 1), ("a b c d x e", 1), ("a c d x e", 0), ("a d e", 0), ("a d x y z e", 0)):
        assert own.found_in(licenses.words(text)) == bool(found), text


# ---- pages

def test_pages_on_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        clean = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " " if "<br>" in b else "", b)).split()) for b in blocks]
        assert r.text.split() == "\n\n".join(filter(None, clean)).split() and r.n_chars == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id="top-menu"><a href=/>Home</a> <a href=/x>More</a></div>
<div class="cookie-notice"><p>We use cookies, and they are good, so accept them please, all of them, right now, today.</p></div>
<div class="layout"><div class="post-content"><h1>A title</h1><p>First para, with commas, and more, to make it long enough to count as text.</p>
<p>Second&nbsp;para &lt;b&gt; &#233; with
 a line, and <b>bold</b><i>x</i>.</p><ul><li>one<li>two</ul><script>var a = "<p>no</p>";</script><form><p>Your mail, please, now</p></form>
<blockquote>Quoted, words, here, that go on for a while.</blockquote><table><tr><td>cell a<td>cell b</table></div>
<aside><p>Side, text, that, has, commas, and words, and more words than it should.</p></aside>
<div id="comments"><article class="comment"><p>A comment, with many, many, commas, and words, and yet more words, in it.</p></article></div></div>
<footer><p>Foot, note</p></footer>"""


def test_page_structure():
    assert html.main_text(PAGE).split("\n\n") == [
        "A title", "First para, with commas, and more, to make it long enough to count as text.", "Second para <b> é with a line, and boldx.",
        "one", "two", "Quoted, words, here, that go on for a while.", "cell a", "cell b"]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text"), (4, "u", "<p>open <b>bold<p>next"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 10),
            (6, "u", "<p>a < b & c <"), (7, "u", "<!-- open"), (8, "u", "<p>x</p>" * 3), (9, "u", "<nav><p>only menu</p></nav>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "", 2: "", 3: "just text", 4: "open bold\n\nnext", 5: "deep", 6: "a < b & c <", 7: "", 8: "x\n\nx\n\nx", 9: ""}


# ---- toxicity

def test_grammar():
    lexicon = toxicity.Lexicon({}, {"vequ": 4.0})
    w = toxicity.FIXED_WEIGHT

    def kinds(text):
        return [round(v, 6) for v in toxicity.matches(text, lexicon)]
    assert kinds("a fine day") == [0, 0, 0, 0]
    assert kinds("what an idiot") == [w, 0, 0, 0]
    assert kinds("you are an idiot") == [0, w, 0, 0]
    assert kinds("idiot, you") == [0, w, 0, 0]
    assert kinds("this is not stupid") == [0, 0, w, 0]
    assert kinds("not today. stupid") == [w, 0, 0, 0]
    assert kinds("Anna said that the plan was stupid. Moron") == [w, 0, 0, w]
    assert kinds("kill time") == [0, 0, 0, 0] and kinds("you I will kill") == [0, w, 0, 0]
    assert kinds("Vequais") == [4, 0, 0, 0]


def test_learns_on_table_and_never_from_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    out = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    assert len(out) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(known[i], r.score, r.predicted) for i, r in out.items() if r.held_out and i in known]
    hits = sum(y and p for y, _, p in held)
    assert hits / sum(y for y, _, _ in held) > 0.9 and hits / sum(p for _, _, p in held) > 0.9
    assert all(p == (s >= 0.5) and 0 <= s <= 1 for _, s, p in held)
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, flipped) == toxicity.train(docs, labels)


def test_toxicity_of_odd_rows(spark, make_docs):
    none = spark.createDataFrame([(None, None), (77, 1)], "doc_id long, toxic int")
    out = {str(r.doc_id): r.predicted for r in toxicity.digest(make_docs([(1, None), (2, ""), (None, "you idiot moron"), (4, "hi")], CLASH), none).collect()}
    assert out == {"1": 0, "2": 0, "None": 1, "4": 0}
    kept = toxicity.without_toxic(make_docs([(1, None), (2, "you idiot, you moron"), (3, "fine")], ["extra"]), none)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns[-1] == "extra"
    assert toxicity.digest(make_docs([]), none).collect() == []
