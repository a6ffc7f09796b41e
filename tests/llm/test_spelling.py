"""Spelling variants against plain restatements."""
import random
import re
import zlib
from collections import Counter

import pytest

from sourceloom.llm import spelling


def plain_words(rows, noise=199, least=6):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                words[run] += 1
    return words


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, factor=5):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x)) if others else None
        form = best if best and words[best] >= factor * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    full = {}
    for w, (form, n, count, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (form, root, n, count, form_n)
    return full


def results(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("least", [1, 5])
def test_table(make_docs, sample_docs, least):
    rows = sample_docs + [(None, sample_docs[0][1]), (7, None), (8, "")]
    words = {w: n for w, n in plain_words(rows, noise=19).items() if n >= least}
    if least == 1:      # all pairs are compared: a part of the vocabulary, as a table of its own
        words = dict(sorted(words.items())[:1500])
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        got = spelling.variants(spelling.frequent(spark.createDataFrame([(w,) for w, n in words.items() for _ in range(n)], "word string"), 1))
        assert results(got) == plain_variants(words)
        return
    df = spelling.noisy_words(make_docs(rows, ["word", "run", "n"]), noise=19)
    got = results(spelling.variants(spelling.frequent(df)))
    assert got == plain_variants(words)
    assert sum(1 for x in got.values() if x[0]) > 3


def test_runs_of_equal_letters_and_chains(spark, make_docs):
    r = random.Random(2)
    words = Counter({"aaaaaa": 3, "aaaaaaa": 20, "aaabaaa": 4, "aabaaaa": 4, "baaaaaa": 100, "abbbbbb": 7, "abbbbb": 40, "bbbbbb": 200,
                     "ààààà": 9, "àààààà": 1, "ÿàààààà": 50})
    for _ in range(300):
        words["".join(r.choice("ab") for _ in range(r.randint(6, 9)))] += r.choice([1, 1, 2, 10, 60, 400])
    long = "xy" * 60
    for w in (long, long + "x", long[:70] + "z" + long[71:], long[:90] + long[91:], "y" + long):
        words[w] += r.randint(1, 9)
    df = spark.createDataFrame([(w,) for w, n in words.items() for _ in range(n)], "word string").repartition(3)
    got = results(spelling.variants(spelling.frequent(df, 1)))
    want = plain_variants(words)
    assert got == want
    assert max(len(w) for w in words if want[w][2]) > 100 and any(x[1] != (x[0] or w) for w, x in want.items())


def test_very_long_word_and_hot_word(make_docs):
    long = "q" * 20_000
    rows = [(i, long + " " + "common " * 40) for i in range(5)] + [(9, ("commun " + long[1:] + " ") * 5)]
    got = results(spelling.digest(make_docs(rows)))
    words = {w: n for w, n in plain_words(rows).items() if n >= 5}
    assert got == plain_variants(words)
    assert got[long][3] == 1 and got["commun"][:2] == ("common", "common")


def test_noise_and_rows_without_id(make_docs):
    rows = [(None, "vocabulary Vocabulary"), (3, "vocabularyÀÿ×"), (3, "vocabularyÀÿ×"), (4, None), (5, ""), (6, "tiny"), (7, "sixsix")]
    for noise in (1, 2, 199):
        got = Counter(r.word for r in spelling.noisy_words(make_docs(rows, ["id", "run"]), noise).collect())
        assert got == plain_words(rows, noise)


def test_empty_table(make_docs):
    assert spelling.digest(make_docs([])).collect() == []
