"""Near-duplicates by Jaccard similarity against all pairs of shingle sets."""
import random

import pytest

import brute
import corpus_pipeline
from sourceloom.llm import shingles


def sets_of(rows, size=5):
    out = {}
    for i, text in rows:
        w = brute.words(brute.lower(text))
        out[i] = frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else [])
    return out


def groups(rows, similarity=0.8):
    sets, parent = sets_of(rows), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            same = len(sets[a] & sets[b])
            if 5 * same >= 4 * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}


def edited():
    """Families of texts around the bound, with a passage that all of them share, and chains of edits."""
    r = random.Random(11)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for family in range(12):
        words = [f"f{family}w{r.randrange(400)}" for _ in range(r.choice((8, 40, 150)))]
        words[len(words) // 2:len(words) // 2] = passage if family % 3 else []
        for _ in range(8):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(r.choice((0, 1, 2, 3))):
                words[r.randrange(len(words))] = f"new{r.random()}"
    rows += ["", None, " \n", "one two", "ONE  two", "one two three", " ".join(passage)]
    order = list(range(len(rows)))
    r.shuffle(order)
    return list(zip(order, rows))


@pytest.mark.parametrize("crowded", [0, 2, 32])
def test_groups_are_those_of_all_pairs(make_docs, monkeypatch, crowded):
    monkeypatch.setattr(shingles, "CROWDED", crowded)
    rows = edited()
    want = groups(rows)
    assert 20 < len(set(want.values())) < len(rows) - 20
    assert {r.rid: r.component for r in shingles.near_duplicates(make_docs(rows)).collect()} == want


def test_stage_drops_near_copies(spark, make_docs):
    words = [f"w{k}" for k in range(200)]
    near, far = list(words), list(words)
    near[50] = near[120] = "changed"            # 186 of 206 shingles are shared
    for k in range(10, 190, 20):
        far[k] = "other"                        # 151 of 241
    docs = make_docs([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
