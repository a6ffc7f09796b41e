"""SpotSigs document fingerprints, in built-in expressions only.

A text's signatures are the chains of CHAIN content words that follow each common word; the set of their
hashes is its fingerprint, written as sorted hex.  Texts with few common words also count single words, and a
text without words is its own signature, so no set is empty.  Two sets are alike as the Jaccard measure says.

near_pairs() finds all alike pairs: equal sets meet first and are one class; classes are partitioned by set
length (only classes of the same or the next partition can be alike), meet on the rarest signatures of each
(prefix filter) and are verified by a Jaccard test that is skipped when the lengths alone rule it out.

Rows: null text is empty; rows without doc_id come after all others in the order; rows that repeat get equal
fingerprints; an empty table gives an empty result; extra columns do not matter.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions.lets import let
from sourceloom.llm.common import id_of, row_key, text_of

CHAIN = 2
FEW = 4
THRESHOLD = 0.8
#: Common words of the four languages, the anchors of signatures.
COMMON = tuple("""
a an and are as at be been but by for from had has have he her his if in into is it its not of on or she that the their
they this to was were which who will with you
als am auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im ist mit nach
nicht noch sich sie sind so über und uns von vor war was wie wir zu zum zur
au aux avec ce ces cette dans de elle en est et il ils je la le les leur mais me ne nous on ou par pas pour que qui sa
sans se ses son sont sur un une vous
al como con cual del el ella ellos esta este ha la las lo los más me mi muy no nos o para pero por se ser si sin sobre su
sus también te tu una uno unos y ya
""".split())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _short(value: Column) -> Column:
    return value.bitwiseAND(F.lit(0xFFFFFFFF)).cast("long")


def _common(word: Column) -> Column:
    return word.isin(*dict.fromkeys(COMMON))


def signatures(own: Column, content: Column, text: Column) -> Column:
    """Sorted distinct signature hashes (32 bits) from a text, its words and its content words."""
    anchors = F.filter(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0))), lambda i: _common(F.get(own, i)))
    # Every common word is an anchor, so j anchors stand before the anchor number j: its chain starts at word i - j.
    chains = F.transform(anchors, lambda i, j: F.when(
        F.get(content, i - j + (CHAIN - 1)).isNotNull(),
        _short(F.xxhash64(F.get(own, i), *[F.get(content, i - j + k) for k in range(CHAIN)]))))

    def chosen(spots: Column) -> Column:
        singles = F.transform(own, lambda w: _short(F.xxhash64(w)))
        return F.when(F.size(own) == 0, F.array(_short(F.xxhash64(text)))).when(
            F.size(spots) < FEW, F.concat(spots, singles)).otherwise(spots)
    return F.array_sort(F.array_distinct(let(F.filter(chains, lambda x: x.isNotNull()), chosen)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def as_text(signature_set: Column) -> Column:
    return F.array_join(F.transform(signature_set, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the set of signatures of a text column.

    Words and content words are bound once: they are read inside a lambda, where an inlined expression would be
    evaluated anew for every element.
    """
    found = let(words(F.col(text)), lambda own: let(
        F.filter(own, lambda w: ~_common(w)), lambda content: signatures(own, content, F.col(text))))
    return df.withColumn(name, found)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(rid, spots) of every row."""
    rows = docs.select(row_key(docs).alias("rid"), text_of(docs).alias("text"))
    return with_signatures(rows, "text", "spots").select("rid", "spots")


def _range_of(key: Column, bounds: list[float]) -> Column:
    """Number of the bounds below the key, by halving."""
    if not bounds:
        return F.lit(0)
    sorted_bounds = F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1)) + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return (F.when(s["lo"] >= s["hi"], s)
                .when(F.get(sorted_bounds, middle) < key, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))
                .otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi"))))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """(rid, text, spots, next_text, next_spots); next: the document of the next smaller doc_id, after the last the first.

    Rows are dealt into ranges of doc_id of about equal size, so no task sees more than a range; the head of
    each range serves the last row of the range before.
    """
    rows = docs.select(row_key(docs).alias("rid"), text_of(docs).alias("text"))
    pieces = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096)
    bounds = rows.select(F.col("rid").cast("double").alias("k")).approxQuantile(
        "k", [i / pieces for i in range(1, pieces)], 1 / (4 * pieces))
    rows = rows.withColumn("span", _range_of(F.col("rid").cast("double"), sorted(set(bounds))))
    dealt = with_signatures(rows.repartition("span"), "text", "spots")
    order = Window.partitionBy("span").orderBy(F.desc("rid"), F.xxhash64("text"))
    follows = dealt.withColumns({"nth": F.row_number().over(order), "follower": F.lead(F.struct("text", "spots")).over(order)})
    heads = follows.filter("nth = 1").select(F.col("span").alias("head_span"), F.struct("text", "spots").alias("head"))
    # One row per range: which range's head follows it.
    spans = heads.select("head_span").distinct()
    ring = Window.orderBy(F.desc("head_span"))
    after = spans.select(F.col("head_span").alias("span"), F.coalesce(
        F.lead("head_span").over(ring), F.first("head_span").over(ring)).alias("next_span"))
    ends = after.join(heads, F.col("next_span") == F.col("head_span")).select(F.col("span").alias("end_span"), "head")
    joined = follows.join(ends, (F.col("span") == F.col("end_span")) & F.col("follower").isNull(), "left")
    other = F.coalesce("follower", "head")
    return joined.select("rid", "text", "spots", other["text"].alias("next_text"), other["spots"].alias("next_spots"))


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how like they are."""
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_spots")
    return rows.select(
        id_of(F.col("rid")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("spots")).alias("fingerprint"),
        as_text(F.col("edited_spots")).alias("edited_fingerprint"),
        jaccard(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        jaccard(F.col("spots"), F.col("next_spots")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Membership (rid, class_id) and all pairs (a, b, likeness) of classes, a < b, at least ``threshold`` alike."""
    prints = fingerprints(docs)
    classes = prints.groupBy("spots").agg(F.min("rid").alias("class_id"))
    members = prints.join(classes, "spots").select("rid", "class_id")
    size = F.size("spots")
    band = F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9)
    sized = classes.select("class_id", "spots", size.alias("n"), band.alias("band"))
    each = sized.select("class_id", "n", F.explode("spots").alias("spot"))
    rarity = each.groupBy("spot").agg(F.count("*").alias("often"))
    nth = F.row_number().over(Window.partitionBy("class_id").orderBy("often", "spot"))
    # Two sets that share t of their union share a signature among the first n - ceil(t n) + 1 of either.
    prefix = each.join(rarity, "spot").withColumn("nth", nth).filter(
        F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("class_id", "spot")
    keyed = prefix.join(sized.select("class_id", "n", "band"), "class_id")
    left = keyed.select(F.col("class_id").alias("a"), "spot", F.col("n").alias("na"),
                        F.explode(F.array("band", F.col("band") + 1, F.col("band") - 1)).alias("meets"))
    right = keyed.select(F.col("class_id").alias("b"), F.col("spot").alias("spot_b"), F.col("n").alias("nb"), F.col("band").alias("band_b"))
    possible = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    met = left.join(right, (F.col("spot") == F.col("spot_b")) & (F.col("meets") == F.col("band_b"))
                    & (F.col("a") < F.col("b")) & possible).select("a", "b").distinct()
    sets_a = classes.select(F.col("class_id").alias("a"), F.col("spots").alias("sa"))
    sets_b = classes.select(F.col("class_id").alias("b"), F.col("spots").alias("sb"))
    pairs = met.join(sets_a, "a").join(sets_b, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness"))
    return members, pairs.filter(F.col("likeness") >= threshold)
