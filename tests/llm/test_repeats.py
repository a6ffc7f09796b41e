"""SimHash groups, substring dedup and line dedup against plain restatements."""
import random

import brute
import pytest

from sourceloom.llm import lines, simhash, substrings

CLASH = ["rid", "fp", "places", "pos", "route", "_key", "key", "text_sha256"]


def corpus(seed=5, docs=40):
    """Few words, so that repeats of all lengths occur; copies, edits, loops, empty and null texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one two"), (105, "loop " * 300),
            (106, "a b\n" * 50), (107, "x" * 5000), (108, "x" * 5000)]
    for i in range(docs):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        if i % 3 == 0:
            a = r.randint(0, 30)
            w[len(w) // 2:len(w) // 2] = passage[a:a + r.randint(15, 30)]
        text = ""
        for k, x in enumerate(w):
            text += x + ("\n" if r.random() < 0.1 else "\t " if r.random() < 0.05 else " ")
        rows.append((i, text))
        if i % 5 == 0:
            rows.append((i + 200, text))
            rows.append((i + 300, text.replace("w1 ", "w2 ", 1)))
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_substrings_match_brute_force(make_docs, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(make_docs(rows, CLASH)).collect()}
    assert got == brute.cut_repeats(rows)
    assert sum(x[1] for x in got.values()) > 300


def test_substrings_on_table(make_docs, sample_docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(make_docs(sample_docs)).collect()}
    assert got == brute.cut_repeats(sample_docs)


def test_lines_match_brute_force(make_docs, sample_docs):
    for rows in (corpus(), sample_docs):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.digest(make_docs(rows, ["kept", "lines", "hashes"])).collect()}
        assert got == brute.delete_lines(rows)
        assert sum(x[2] for x in got.values()) > 5


def test_runs_are_measured_whole(make_docs):
    short = "\n".join(f"line {i:05d}" for i in range(200))
    notice = "This page is provided by the archive for readers; see the terms before reuse."
    rows = [(1, short), (2, short), (3, f"one\n{notice}\ntwo"), (4, f"three\n{notice}\nfour"), (5, "hello\n\nfive"), (6, "hello\n\nsix"),
            (7, "\n".join(str(i) for i in range(8))), (8, "\n".join(str(i) for i in range(8))), (9, "zz\n" * 60), (10, "x" * 200_000 + "\nb"),
            (11, "a\n" + "x" * 200_000)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.digest(make_docs(rows)).collect()}
    assert got == brute.delete_lines(rows)
    removed = {i: x[2] for i, x in got.items()}
    assert (removed[1], removed[2], removed[3], removed[4], removed[6], removed[8], removed[10], removed[11]) == (0, 200, 0, 1, 0, 0, 0, 1)


def test_rows_that_repeat_a_doc_id_share_places(make_docs):
    long = "a line of more than forty characters, which stands alone"
    rows = [(1, long), (2, "x\ny\n" + long), (2, "q")]
    assert sorted((r.doc_id, r.text) for r in lines.digest(make_docs(rows)).collect()) == [(1, long), (2, "q"), (2, "x\ny")]


def test_lines_stage_drops_only_emptied_documents(make_docs):
    long = "a sentence of many words that goes on and on until it is long enough to count as one run by itself, indeed longer than that"
    rows = [(1, long + " one\nsecond"), (2, long + " one\nother end"), (3, "first line here\n" + long + " one"), (4, long + " one"),
            (5, ""), (6, None), (7, "short")]
    out = {r.doc_id: (r.text, r.n_chars) for r in lines.without_repeated(make_docs(rows, ["_places2"])).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("other end", 9), 3: ("first line here", 15), 5: ("", 0), 6: (None, None), 7: ("short", 5)}


def test_simhash_matches_brute_force(make_docs, sample_docs):
    for rows in (corpus(), sample_docs):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(make_docs(rows, CLASH)).collect()}
        assert got == brute.near_components(rows)


def test_near_links_are_complete(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for flips in (1, 2, 2, 3):
            x = b
            for bit in r.sample(range(64), flips):
                x ^= 1 << bit
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    nodes = spark.createDataFrame([(v, 1) for v in signed], "fp long, least long")
    assert sorted(map(tuple, simhash.near_links(nodes).collect())) == sorted(want)
    crowded, simhash.CROWDED = simhash.CROWDED, 0
    try:
        assert sorted(map(tuple, simhash.near_links(nodes).collect())) == sorted(want)
    finally:
        simhash.CROWDED = crowded


def test_long_chain_is_one_component(make_docs, spark):
    from sourceloom.llm.components import components
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 if i <= 30 else 31 for i in range(61)}


def test_representatives(make_docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text), (2, text), (2, text), (7, "other words entirely"), (None, text), (None, "quite new text here"), (9, "")]
    out = simhash.representatives(make_docs(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 2), (False, 7), (False, 9), (True, 0)]


def test_rows_that_repeat_and_rows_without_id(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text), (None, None)]
    out = sorted((str(r.doc_id), r.n_removed) for r in substrings.digest(make_docs(rows)).collect())
    assert out == [("1", 0), ("1", 0), ("2", 30), ("None", 0), ("None", 30)]


def test_empty_tables(make_docs):
    none = make_docs([])
    for call in (substrings.digest, lines.digest, lines.without_repeated, simhash.digest, simhash.representatives):
        assert call(none).collect() == []
