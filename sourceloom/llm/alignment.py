"""Alignment of two tokenizers by a monoid of fragments.

Both tokenizers read a blank and the text.  Byte offsets at which a token of each ends cut the tokens into
groups.  A *fragment* is what a range of bytes knows of that: the tokens before its first common end (open prefix),
the closed groups, and the tokens after its last common end (open suffix).  Joining two fragments closes the
group that the suffix of one and the prefix of the other form; the operation is associative and the empty
fragment is neutral, so fragments of one document may be composed in any tree.

Short documents are one fragment, made beside the text.  Long ones are cut into pieces of about PIECE
characters, which are tokenised in tasks of their own; the tokens of a piece are dealt to ranges of RANGE bytes,
one fragment each.  Fragments are composed in rounds, FAN of one document at a time, until each document is one.
A piece may begin only at a blank between two visible characters: no token of the byte vocabulary goes on
past the character before such a blank, and no piece of the other vocabulary holds a blank after anything but
blanks (checked when it is loaded), so pieces give the same tokens as the whole text.  A text without such a
place is one piece.

Closed groups are kept as text and as counted pairs of ids.  Pairs are counted over the corpus in blocks: a block of
documents sends each of its distinct pairs once, with the number of documents that hold it, and gets back the count
over all documents and whether that is the highest of the A id.  So a pair that stands in every document travels
once per block.

Rows: null and empty texts have no tokens; a text that either tokenizer would not give back byte by byte has none
either; rows that repeat count as documents of their own; a row without doc_id keeps a null one; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, store

#: Characters of a piece (a longer text is cut), bytes of a fragment's range, fragments composed at a time.
PIECE, RANGE, FAN = 65_536, 16_384, 16
#: Distinct pairs, summed over documents, that a block holds.
BLOCK = 1_000_000
#: A group with more links than this is counted by distinct ids instead of link by link.
WIDE = 4_096


# --- the two vocabularies --------------------------------------------------------------------------
class Tokenizer:
    """ids and token bytes of blank + text."""

    def __init__(self, encode, entries: list[bytes]):
        self.encode, self.entries = encode, entries
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))

    def read(self, text: str) -> np.ndarray | None:
        """ids, or None if they do not spell the blank and the text."""
        ids = self.encode(text)
        if b"".join(map(self.entries.__getitem__, ids)) != (" " + text).encode("utf-8", "surrogatepass"):
            return None
        return np.array(ids, np.int64)


@functools.lru_cache(maxsize=4)
def byte_tokenizer(path: str | None = None) -> Tokenizer:
    """The byte-level vocabulary (a tokenizers JSON file), read in rank form."""
    import public_tokenizers
    import tiktoken
    name = (path or public_tokenizers.path("byte_bpe_50k.json")).removesuffix(".json") + ".tiktoken"
    with open(name, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    entries = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        entries[rank] = token
    return Tokenizer(lambda text: fast.encode_ordinary(" " + text), entries)


@functools.lru_cache(maxsize=4)
def piece_tokenizer(path: str | None = None) -> Tokenizer:
    """The sentencepiece vocabulary; it adds the blank itself."""
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"a piece of the vocabulary goes on after a blank: {piece!r}")
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokenizer(lambda text: model.encode(text, num_threads=1), entries)


def cuts(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters; each but the first has lost the blank that it begins with."""
    out, begin = [], 0
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 <= at < len(text) - 1:
            break
        out.append(text[begin:at])
        begin = at + 1
    return [*out, text[begin:]]


# --- fragments -------------------------------------------------------------------------------------
class Fragment:
    """Open prefix, closed groups and open suffix of a range of bytes; ids of A and of B."""

    __slots__ = ("ok", "closed", "prefix", "suffix", "counts", "text", "pairs", "times")

    def __init__(self):
        none = np.empty(0, np.int64)
        self.ok, self.closed = True, False                    # closed: holds a common end
        self.prefix, self.suffix = (none, none), (none, none)
        self.counts = np.zeros(4, np.int64)                   # A tokens, B tokens, groups and links, all closed
        self.text = b""                                       # closed groups, each followed by ";"
        self.pairs, self.times = none, none                   # distinct linked pairs and their links

    @classmethod
    def of(cls, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, first: bool = False) -> Fragment:
        """``first``: the range begins the document, so its begin is a common end of what came before."""
        out = cls()
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cut, b_cut = np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1
        if first:
            a_cut, b_cut = np.concatenate(([0], a_cut)), np.concatenate(([0], b_cut))
        if not len(a_cut):
            out.prefix = (a, b)
            return out
        out.closed = True
        out.prefix, out.suffix = (a[:a_cut[0]], b[:b_cut[0]]), (a[a_cut[-1]:], b[b_cut[-1]:])
        a, b = a[a_cut[0]:a_cut[-1]], b[b_cut[0]:b_cut[-1]]
        out._close(a, np.diff(a_cut), b, np.diff(b_cut))
        return out

    def _close(self, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> None:
        """Appends groups of the given sizes."""
        if not len(a_sizes):
            return
        links = a_sizes * b_sizes
        self.counts += (len(a), len(b), len(links), links.sum())
        self.text += _spelled(a, a_sizes, b, b_sizes)
        a_from, b_from = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
        few = np.flatnonzero(links <= WIDE)
        n = links[few]
        group = np.repeat(few, n)
        within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        pairs = [_pair(a[a_from[group] + within // b_sizes[group]], b[b_from[group] + within % b_sizes[group]])]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(links > WIDE).tolist():
            a_ids, a_times = np.unique(a[a_from[g]:a_from[g] + a_sizes[g]], return_counts=True)
            b_ids, b_times = np.unique(b[b_from[g]:b_from[g] + b_sizes[g]], return_counts=True)
            pairs.append(_pair(np.repeat(a_ids, len(b_ids)), np.tile(b_ids, len(a_ids))))
            times.append(np.outer(a_times, b_times).ravel())
        self._count(pairs, times)

    def _count(self, pairs: list[np.ndarray], times: list[np.ndarray]) -> None:
        self.pairs, self.times = summed(np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times]))

    def join(self, after: Fragment) -> Fragment:
        """This range followed by another one."""
        out = Fragment()
        out.ok, out.closed = self.ok and after.ok, self.closed or after.closed
        if not self.closed:
            out.prefix = _both(self.prefix, after.prefix)
            out.suffix, out.counts, out.text = after.suffix, after.counts, after.text
            out.pairs, out.times = after.pairs, after.times
            return out
        out.prefix, out.counts, out.text, out.pairs, out.times = self.prefix, self.counts.copy(), self.text, self.pairs, self.times
        if not after.closed:
            out.suffix = _both(self.suffix, after.prefix)
            return out
        a, b = _both(self.suffix, after.prefix)
        out._close(a, np.array([len(a)]), b, np.array([len(b)]))
        out.suffix, out.counts, out.text = after.suffix, out.counts + after.counts, out.text + after.text
        out._count([after.pairs], [after.times])
        return out


def _both(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], np.add.reduceat(values, begin)


@functools.lru_cache(maxsize=4)
def _decimals(size: int) -> np.ndarray:
    return np.array([b"%d" % i for i in range(size)], object)


def _spelled(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> bytes:
    """a1,a2|b1;a3|b2,b3; with a separator after every id."""
    total = len(a) + len(b)
    size = 1 << int(max(a.max(initial=0), b.max(initial=0))).bit_length()
    sizes = np.empty(2 * len(a_sizes), np.int64)
    sizes[0::2], sizes[1::2] = a_sizes, b_sizes
    in_a = np.repeat(np.arange(len(sizes)) % 2 == 0, sizes)
    parts = np.empty(2 * total, object)
    ids = np.empty(total, np.int64)
    ids[in_a], ids[~in_a] = a, b
    parts[0::2] = _decimals(size)[ids]
    marks = np.full(total, b",", object)
    last = np.cumsum(sizes) - 1
    marks[last[0::2]], marks[last[1::2]] = b"|", b";"
    parts[1::2] = marks
    return b"".join(parts.tolist())


def fragments(text: str, a: Tokenizer, b: Tokenizer, begin: int = 0, size: int | None = None) -> Iterator[tuple[int, Fragment]]:
    """(range number, fragment) of blank + text, whose bytes begin at ``begin`` of a document; without size one range."""
    a_ids, b_ids = a.read(text), b.read(text)
    if a_ids is None or b_ids is None:
        broken = Fragment()
        broken.ok = False
        yield (begin // size if size else 0), broken
        return
    a_ends, b_ends = begin + np.cumsum(a.lengths[a_ids]), begin + np.cumsum(b.lengths[b_ids])
    end = int(a_ends[-1])
    size = size or end
    for n in range(begin // size, -(-end // size)):
        (i, j), (k, m) = (np.searchsorted(ends, (n * size, (n + 1) * size), "right") for ends in (a_ends, b_ends))
        first = begin == 0 and n == 0
        if first or j > i or m > k:
            yield n, Fragment.of(a_ids[i:j], a_ends[i:j], b_ids[k:m], b_ends[k:m], first)


def composed(parts: list[Fragment]) -> Fragment:
    """All of them, in order, by a balanced tree."""
    while len(parts) > 1:
        parts = [x.join(y) for x, y in zip(parts[::2], parts[1::2])] + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


# --- Spark -----------------------------------------------------------------------------------------
_PIECES = "uid long, doc_id long, nth int, begin long, piece string"
_PARTS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("nth", pa.int32()), ("ok", pa.bool_()),
                    ("closed", pa.bool_()), ("a_prefix", pa.list_(pa.int32())), ("b_prefix", pa.list_(pa.int32())),
                    ("a_suffix", pa.list_(pa.int32())), ("b_suffix", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
                    ("text", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_PARTS_SQL = ("uid long, doc_id long, at long, nth int, ok boolean, closed boolean, a_prefix array<int>, b_prefix array<int>, "
              "a_suffix array<int>, b_suffix array<int>, counts array<long>, text binary, pairs array<long>, times array<long>")
_ALIGNED = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                      ("n_links", pa.int64()), ("sha", pa.string()), ("refs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
                      ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32()))])
_ALIGNED_SQL = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, refs array<int>, "
                "times array<int>, pairs array<long>, held array<int>")
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_RESULT_SQL = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for uid, doc_id, text in zip(batch["uid"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                pieces = cuts(text, size)
                sizes = [len(p.encode("utf-8", "surrogatepass")) + 1 for p in pieces]
                begins = (np.cumsum(sizes) - sizes).tolist()
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array(begins, pa.int64()), pa.array(pieces, pa.string())], ["uid", "doc_id", "nth", "begin", "piece"])
    return run


def _part(uid: int, doc_id: int | None, at: int, nth: int, f: Fragment) -> tuple:
    return (uid, doc_id, at, nth, f.ok, f.closed, *f.prefix, *f.suffix, f.counts, f.text, f.pairs, f.times)


def _parts_of(rows: pa.RecordBatch | pa.Table) -> Iterator[Fragment]:
    columns = [rows[n].combine_chunks() if isinstance(rows, pa.Table) else rows[n] for n in _PARTS.names[4:]]

    def ints(column: pa.Array, i: int) -> np.ndarray:
        return column[i].values.to_numpy().astype(np.int64)

    for i in range(rows.num_rows):
        ok, closed, ap, bp, asx, bsx, counts, text, pairs, times = columns
        out = Fragment()
        out.ok, out.closed, out.text = ok[i].as_py(), closed[i].as_py(), text[i].as_py()
        out.prefix, out.suffix = (ints(ap, i), ints(bp, i)), (ints(asx, i), ints(bsx, i))
        out.counts, out.pairs, out.times = ints(counts, i), ints(pairs, i), ints(times, i)
        yield out


def _fragment_rows(size: int, a_path: str | None, b_path: str | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokenizer(a_path), piece_tokenizer(b_path)
        for batch in batches(parts):
            for uid, doc_id, nth, begin, piece in zip(*(batch[n].to_pylist() for n in ("uid", "doc_id", "nth", "begin", "piece")), strict=True):
                yield _table([_part(uid, doc_id, at, nth, f) for at, f in fragments(piece, a, b, begin, size)], _PARTS)
    return run


def _compose(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for the fragments of a document that share a range of the next round."""
    rows = rows.sort_by([("at", "ascending"), ("nth", "ascending")])
    whole = composed(list(_parts_of(rows)))
    return pa.Table.from_batches([_table([_part(key[0].as_py(), rows["doc_id"][0].as_py(), key[1].as_py(), 0, whole)], _PARTS)])


class _Block:
    """Documents of a task until they hold BLOCK pairs; then they go out with their distinct pairs."""

    def __init__(self, side: int, limit: int):
        self.number = (TaskContext.get().partitionId() * 2 + side) << 24
        self.limit, self.held, self.rows, self.pairs = limit, 0, [], []

    def add(self, doc_id: int | None, f: Fragment | None) -> Iterator[pa.RecordBatch]:
        if f is None or not f.ok:
            f, sha = Fragment(), ""
        else:
            sha = hashlib.sha256(f.text[:-1]).hexdigest()
        self.rows.append((self.number, doc_id, *f.counts.tolist(), sha, len(f.pairs), f.times, None, None))
        self.pairs.append(f.pairs)
        self.held += len(f.pairs) + 10
        if self.held >= self.limit:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        known, refs, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        at, rows = 0, []
        for row in self.rows:
            rows.append((*row[:7], refs[at:at + row[7]].astype(np.int32), row[8].astype(np.int32), None, None))
            at += row[7]
        for i in range(0, len(rows), 1000):
            yield _table(rows[i:i + 1000], _ALIGNED)
        yield _table([(self.number, *[None] * 8, known, held.astype(np.int32))], _ALIGNED)
        self.number, self.held, self.rows, self.pairs = self.number + 1, 0, [], []


def _short_rows(limit: int, a_path: str | None, b_path: str | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, block = byte_tokenizer(a_path), piece_tokenizer(b_path), _Block(0, limit)
        for batch in batches(parts):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                yield from block.add(doc_id, next(fragments(text, a, b))[1] if text else None)
        yield from block.out()
    return run


def _long_rows(limit: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(1, limit)
        for batch in parts:
            for doc_id, f in zip(batch["doc_id"].to_pylist(), _parts_of(batch), strict=True):
                yield from block.add(doc_id, f)
        yield from block.out()
    return run


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, piece: int = PIECE, size: int = RANGE,
            fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Stored rows of documents (doc_id, counts, sha, refs, times) and of blocks (pairs, held); refs are places in pairs."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    long = F.coalesce(F.length("text") > piece, F.lit(False))
    short = rows.filter(~long).mapInArrow(_short_rows(block, a_path, b_path), _ALIGNED_SQL)
    pieces = (rows.filter(long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
              .mapInArrow(_cut(piece), _PIECES).repartition(F.col("uid"), F.col("nth")))
    parts = store(pieces.mapInArrow(_fragment_rows(size, a_path, b_path), _PARTS_SQL))
    last = parts.agg(F.max("at")).first()[0]                       # one number: how many rounds
    while last is not None:
        parts = store(parts.groupBy("uid", F.floor(F.col("at") / fan).alias("next")).applyInArrow(_compose, _PARTS_SQL))
        if last < fan:
            break
        last //= fan
    return store(short.unionByName(parts.mapInArrow(_long_rows(block), _ALIGNED_SQL)))


def _looked_up(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a block with the corpus counts of the block's pairs."""
    pairs = pairs.sort_by("pair")
    count = pairs["count"].combine_chunks().to_numpy()
    best = pairs["best"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    docs = docs.combine_chunks()
    refs, times = docs["refs"].combine_chunks(), docs["times"].combine_chunks()
    sizes = refs.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    at, n = refs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = np.zeros((2, len(sizes)), np.int64)
    np.add.at(sums[0], row, n * best[at])
    np.add.at(sums[1], row, n * count[at])
    named = [docs[c].combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*named, pa.array(sums[0]), pa.array(sums[1]), docs["sha"].combine_chunks()], schema=_RESULT)


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair, and whether no pair of the same A id is held by more."""
    counted = blocks.groupBy("pair").agg(F.sum("held").alias("count"))
    same = Window.partitionBy(F.shiftright("pair", 32))
    return counted.withColumn("best", F.col("count") == F.max("count").over(same))


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    found = aligned(docs, **options)
    blocks = found.filter("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(
        "block", F.col("x.pairs").alias("pair"), F.col("x.held").cast("long").alias("held"))
    counted = blocks.select("block", "pair").join(link_counts(blocks), "pair").select(
        F.col("block").alias("of"), "pair", "count", "best")
    texts = found.filter("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "refs", "times")
    return texts.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_looked_up, _RESULT_SQL)
