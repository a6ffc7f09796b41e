"""Spelling variants by a dictionary of trie-node pairs.

Words are numbered in the order in which they are preferred as forms.  Every prefix of a word is a node of the forward trie and every suffix a
node of the reversed trie; both kinds are numbered.  Nodes of up to three letters are so common that their number
is the letters themselves; the others get one from a stored table of the nodes that two words share.  From then on only
integers travel.  A word of length L has L + 1 gaps (prefix node i, suffix node i) and L skips (prefix node i,
suffix node i + 1).  Two words differ by one replaced letter exactly if a skip of both is the same pair, and by one
inserted letter exactly if a gap of the shorter one is a skip of the longer one.  A letter inside a run of equal
letters may be skipped at several places with the same result, so only the first place of a run meets gaps; then
each pair of near words meets under one key only.

No pair is written out: the words of a key tell every member how many neighbours it has there and which of
them is best.  A key has as many members as there are letters, whatever the corpus holds.

Prefixes and suffixes of up to DEEP letters stand for themselves, so nodes are exact; deeper ones are named by a
128-bit digest that is carried on letter by letter, so a word of a million letters costs a million small rows.

Rows: null texts have no words; a row without doc_id counts with the empty string as its id; repeated rows count
as often as they occur; texts of any length are read whole, by expressions beside the text; an empty table gives
an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, store

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many words of a document loses a letter; least length and count of a word; by how much a form is more frequent.
NOISE, LEAST_LENGTH, LEAST_COUNT, FACTOR = 199, 6, 5, 5
#: Letters of a node whose number is the letters themselves, and up to which a node is named by its letters.
SHALLOW, DEEP = 3, 64
_NODES = "wid long, at int, fresh int, side int, node long, name binary"
_FIELDS = pa.schema([("wid", pa.int64()), ("at", pa.int32()), ("fresh", pa.int32()), ("side", pa.int32()), ("node", pa.int64()),
                     ("name", pa.binary())])
_ROWS = 50_000


def noisy_words(docs: DataFrame, noise: int = NOISE, least: int = LEAST_LENGTH) -> DataFrame:
    """(word) of every run of letters, some of them without one letter; a run too short to become a word is not made."""
    low = F.translate(F.col("text"), UPPER, LOWER)
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), docs["text"].alias("text")).select(
        "id", F.explode(F.regexp_extract_all(low, F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (h % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % noise == 0, without).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least)


def frequent(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(wid, word, n): stored; of two words the one with the larger n, or the smaller one of equal n, has the larger wid."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return store(counted.orderBy("n", F.desc("word")).select(F.monotonically_increasing_id().alias("wid"), "word", "n"))


def _packed(letters: str, side: int) -> int:
    """A number below zero for a node of few letters: the letters, their number and the trie."""
    value = 1
    for x in letters:
        value = value << 16 | ord(x)
    return -(value << 1 | side) - 1


def _names(letters: str) -> list[bytes]:
    """Names of the nodes of more than SHALLOW letters on the way down: the letters, below DEEP their digest."""
    out = [letters[:i].encode() for i in range(SHALLOW + 1, min(len(letters), DEEP) + 1)]
    if len(letters) > DEEP:
        digest = xxhash.xxh3_128(letters[:DEEP].encode())
        for x in letters[DEEP:]:
            digest.update(x.encode())
            out.append(b"\xff" + digest.digest())                       # no UTF-8 starts with this byte
    return out


def _trie_nodes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)],
                                         schema=_FIELDS)
        rows.clear()
        return out

    for batch in batches(parts):
        for wid, word in zip(batch["wid"].to_pylist(), batch["word"].to_pylist(), strict=True):
            fresh = [int(i == 0 or word[i] != word[i - 1]) for i in range(len(word))] + [0]
            for side, letters in ((0, word), (1, word[::-1])):
                for i in range(min(SHALLOW, len(word)) + 1):
                    rows.append((wid, len(word) - i if side else i, fresh[i], side, _packed(letters[:i], side), None))
                for i, name in enumerate(_names(letters), SHALLOW + 1):
                    rows.append((wid, len(word) - i if side else i, fresh[i], side, None, name))
                    if len(rows) >= _ROWS:
                        yield flush()
    if rows:
        yield flush()


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, code): gaps and skips of each word as pairs of node numbers.

    code is 4 * wid, plus 2 for a skip, plus 1 if that is the first place of a run of equal letters.  A named node
    that only one word goes through joins nothing and is left out.
    """
    nodes = store(words.select("wid", "word").mapInArrow(_trie_nodes, _NODES))
    named = nodes.filter("name is not null")
    numbers = store(named.groupBy("side", "name").agg(F.count(F.lit(1)).alias("through")).filter("through > 1")
                    .select("side", "name", F.monotonically_increasing_id().alias("number")))
    numbered = named.join(numbers, ["side", "name"]).select("wid", "at", "fresh", "side", F.col("number").alias("node"))
    placed = numbered.unionByName(nodes.filter("node is not null").select("wid", "at", "fresh", "side", "node"))
    # the prefix node of a place, the suffix node of its gap and that of its skip, which begins one letter later
    at = F.explode(F.when(F.col("side") == 0, F.array(F.struct(F.col("at").alias("place"), F.lit(0).alias("role"))))
                   .otherwise(F.array(F.struct(F.col("at").alias("place"), F.lit(1).alias("role")),
                                      F.struct((F.col("at") - 1).alias("place"), F.lit(2).alias("role"))))).alias("m")

    def of(role: int, column: str = "node") -> Column:
        return F.max(F.when(F.col("m.role") == role, F.col(column)))

    met = (placed.select("wid", "node", "fresh", at).filter("m.place >= 0").groupBy("wid", "m.place")
           .agg(of(0).alias("p"), of(0, "fresh").alias("fresh"), of(1).alias("gap"), of(2).alias("skip")).filter("p is not null"))
    code = F.col("wid") * 4
    return met.select("p", F.explode(F.array(
        F.struct(F.col("gap").alias("s"), code.alias("code")),
        F.struct(F.col("skip").alias("s"), (code + 2 + F.col("fresh")).alias("code")))).alias("v")).select(
        "p", "v.*").filter("s is not null")


def neighbours(words: DataFrame) -> DataFrame:
    """(wid, n_near, best): number of near words of each word that has any, and the largest wid among them."""
    members = (node_pairs(words).groupBy("p", "s").agg(F.collect_list("code").alias("all")).filter(F.size("all") > 1)
               .withColumns({"skips": F.filter("all", lambda x: x.bitwiseAND(2) == 2),
                             "firsts": F.filter("all", lambda x: x.bitwiseAND(3) == 3),
                             "gap": F.get(F.filter("all", lambda x: x.bitwiseAND(2) == 0), F.lit(0))})
               .select("skips", "firsts", "gap", F.explode("all").alias("me")))
    skip, first = F.col("me").bitwiseAND(2) == 2, F.col("me").bitwiseAND(3) == 3
    meets = F.when(first, F.col("gap"))
    others = F.array_max(F.filter("skips", lambda x: x != F.col("me")))
    seen = members.select(
        F.shiftright("me", 2).alias("wid"),
        F.when(skip, F.size("skips") - 1 + meets.isNotNull().cast("int")).otherwise(F.size("firsts")).alias("c"),
        F.shiftright(F.when(skip, F.greatest(others, meets)).otherwise(F.array_max("firsts")), 2).alias("top"))
    return seen.filter("c > 0").groupBy("wid").agg(F.sum("c").alias("n_near"), F.max("top").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root) of every word that has a form (wid, form): the end of the chain, by doubling the steps."""
    steps = store(forms.select("wid", F.col("form").alias("root")))
    while True:
        up = steps.select(F.col("wid").alias("at"), F.col("root").alias("next"))
        longer = store(steps.join(up, F.col("root") == F.col("at"), "left").select(
            "wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("wid", "root")
        if longer.filter("moved").isEmpty():
            return steps


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for (wid, word, n) as :func:`frequent` stores it."""
    best = words.select(F.col("wid").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    near = words.join(neighbours(words), "wid", "left").join(best, "best", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    chosen = store(near.select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("next"),
        F.when(is_form, F.col("best_word")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(chosen.filter("next is not null").select("wid", F.col("next").alias("form")))
    tops = words.select(F.col("wid").alias("root"), F.col("word").alias("root_word"))
    full = chosen.join(ends, "wid", "left").join(tops, "root", "left")
    return full.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(frequent(noisy_words(docs)))


#: DuckDB: the result of digest().  It has no CRC-32, so that is stated bit by bit.
SQL = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS k
         FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}+')) AS run FROM documents)
         WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
bytes AS (SELECT run, k, flatten(list_transform(string_split(named, ''), lambda c:
          CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) AS b FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
           xor(crcs[(xor(c, x::BIGINT) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc),
formed AS (SELECT CASE WHEN h % {NOISE} = 0 THEN run[:(h % length(run))::INTEGER] || run[(h % length(run))::INTEGER + 2:] ELSE run END AS word, k
           FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM formed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word
                       HAVING sum(k) >= {LEAST_COUNT}),
places AS (SELECT word, i, word[:i] AS head, word[i + 2:] AS tail FROM words, unnest(range(length(word))) AS g(i)),
without AS (SELECT DISTINCT word AS longer, head || tail AS shorter FROM places),
links AS (SELECT a.word, b.word AS other FROM places a JOIN places b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
          UNION ALL SELECT longer, shorter FROM without WHERE shorter IN (SELECT word FROM words)
          UNION ALL SELECT shorter, longer FROM without WHERE shorter IN (SELECT word FROM words)),
ranked AS (SELECT links.word, other, n AS other_n, count(*) OVER (PARTITION BY links.word) AS n_near,
           row_number() OVER (PARTITION BY links.word ORDER BY n DESC, other) AS nth FROM links JOIN words ON words.word = other),
forms AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * n THEN other END AS form,
          CASE WHEN other_n >= {FACTOR} * n THEN other_n END AS form_n
          FROM words w LEFT JOIN ranked r ON r.word = w.word AND nth = 1),
chain AS (SELECT word, word AS at FROM forms
          UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.at WHERE form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain USING (word) JOIN forms e ON e.word = chain.at AND e.form IS NULL
"""
