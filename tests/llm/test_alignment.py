"""Alignment of two tokenizers against a plain restatement."""
import base64
import hashlib
import random
from collections import Counter

import pytest

from sourceloom.llm import alignment

FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def readers():
    """Functions from a text to (id, token bytes) of each tokenizer, by the JSON file and the model."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        entry = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def a(text):
        return [(i, entry[i]) for i in whole.encode(" " + text, add_special_tokens=False).ids]

    def b(text):
        return [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
                for i in model.encode(text) for p in [model.id_to_piece(i)]]
    return a, b


def plain(rows, readers):
    """One result for each row, in order."""
    seen = []
    for _, text in rows:
        groups = []
        if text:
            read = [r(text) for r in readers]
            whole = (" " + text).encode()
            if all(b"".join(t for _, t in side) == whole for side in read):
                ends = []
                for side in read:
                    at, own = 0, []
                    for _, t in side:
                        at += len(t)
                        own.append(at)
                    ends.append(own)
                common = sorted(set(ends[0]) & set(ends[1]))
                for low, high in zip([0, *common], common):
                    groups.append(tuple([i for (i, _), e in zip(side, own) if low < e <= high] for side, own in zip(read, ends)))
        seen.append(groups)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in seen]
    count = Counter(p for own in links for p in own)
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for groups, own in zip(seen, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


ODD = [(900, None), (901, ""), (902, " "), (903, "x▁y"), (904, "<|endoftext|> and <s> or <unk> text"), (905, "a  b\t\n c  "),
       (906, "日本語のテキスト 🙂🙂 é́ ﬁ"), (907, "\x00 nul"), (908, "x" * 3000), (909, "'s 'll don't  I'd"), (None, "without id"),
       (910, "same text"), (910, "same text"), (911, "  lead"), (912, " 　 wide space ")]


def check(df, rows, readers):
    got = sorted((r.doc_id is None, r.doc_id or 0, *(r[f] for f in FIELDS)) for r in df.collect())
    assert got == sorted((i is None, i or 0, *v) for (i, _), v in zip(rows, plain(rows, readers)))


def test_table(make_docs, sample_docs, readers):
    rows = sample_docs + ODD
    check(alignment.digest(make_docs(rows, ["block", "refs", "pair", "uid"])), rows, readers)


def test_long_documents_in_fragments(make_docs, sample_docs, readers):
    """Small pieces, ranges and blocks: every document is composed from many fragments in several rounds."""
    rows = sample_docs[:60] + ODD + [(950, "no blank " + "абв" * 400 + " end  of it "), (951, "🙂" * 500), (952, "ab ▁ " * 300)]
    df = alignment.digest(make_docs(rows), piece=200, size=64, fan=3, block=500)
    check(df, rows, readers)


def test_cuts_give_the_same_tokens(sample_docs, readers):
    r = random.Random(1)
    alphabet = ["a", "B", "9", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "日", "🙂", " ", "　", "<s>", "_", "́"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 300))) for _ in range(300)] + [t for _, t in sample_docs[:50]]
    a, b = alignment.byte_tokenizer(), alignment.piece_tokenizer()
    for text in texts:
        pieces = alignment.cuts(text, 20)
        assert " ".join(pieces) == text
        for own in (a, b):
            assert [i for p in pieces for i in own.encode(p)] == own.encode(text)


def test_monoid(sample_docs):
    """Any split and any bracketing give the fragment of the whole."""
    r = random.Random(3)
    a, b = alignment.byte_tokenizer(), alignment.piece_tokenizer()

    def state(f):
        return (f.ok, f.closed, [x.tolist() for x in (*f.prefix, *f.suffix)], f.counts.tolist(), f.text, f.pairs.tolist(), f.times.tolist())

    for text in [t for _, t in sample_docs[:12]] + ["日本語 🙂🙂 text", "x" * 200]:
        whole = state(next(alignment.fragments(text, a, b))[1])
        for size in (1, 3, 7, 50):
            parts = [f for _, f in alignment.fragments(text[:400], a, b, size=size)]
            if len(text) > 400:
                whole = state(next(alignment.fragments(text[:400], a, b))[1])
            neutral = alignment.Fragment()
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                parts[i:i + 2] = [parts[i].join(neutral).join(parts[i + 1])]
            assert state(parts[0]) == whole


def test_wide_groups_count_the_same(monkeypatch, sample_docs):
    a, b = alignment.byte_tokenizer(), alignment.piece_tokenizer()
    text = sample_docs[3][1] + " 🙂日本" * 9
    before = next(alignment.fragments(text, a, b))[1]
    monkeypatch.setattr(alignment, "WIDE", 1)
    after = next(alignment.fragments(text, a, b))[1]
    assert before.pairs.tolist() == after.pairs.tolist() and before.times.tolist() == after.times.tolist()


def test_empty_table(make_docs):
    assert alignment.digest(make_docs([])).collect() == []
