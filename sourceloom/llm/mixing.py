"""Mixing sources to target weights by Poisson replication, in built-in expressions only.

Every source gets a repetition rate: its share of the target weights times the corpus size, over its own
size in characters.  A document occurs as often as a Poisson number with that mean, found by inverting the
distribution at a uniform number that is a hash of the document and a seed, so a run can be repeated.  The
copies are then dealt to partitions by another hash and ordered by it there, which is a shuffle of the whole
corpus.

A mean of more than STEP is the sum of independent parts of at most STEP each, so no rate is too large for
the inversion.  Sources are few as a rule, but nothing relies on it: their statistics are combined on the map
side and broadcast only when counted to be at most MOST_SOURCES; beyond that, they are joined by a salted
shuffle that spreads a source with very many documents.

Rows: null text is empty; a null source is a source of its own; a source whose texts are all empty has rate
one per document; rows without doc_id are told apart by their text; rows that repeat get equal numbers of
copies; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import free_names, row_key, store, text_of

SEED = 17
STEP = 16.0
MOST_SOURCES = 10_000
SALTS = 64
#: Terms of the inverted distribution for a mean of at most STEP: the tail beyond is below 1e-16.
TERMS = 80


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0) -> DataFrame:
    """(source_key, documents, chars, weight, rate) of every source."""
    source = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("null"))
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source_key") == f"={name}", F.lit(float(value))).otherwise(weight)
    sizes = store(docs.select(source.alias("source_key"), F.length(text_of(docs)).cast("long").alias("n")).groupBy("source_key").agg(
        F.count("*").alias("documents"), F.sum("n").alias("chars")).withColumn("weight", weight))
    all_chars, all_weight = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = F.col("weight") * F.lit(all_chars) / (F.lit(all_weight) * F.col("chars"))
    rate = (F.when(F.lit(all_weight <= 0) | (F.col("weight") <= 0), 0.0).when(F.col("chars") == 0, 1.0).otherwise(share))
    return sizes.withColumn("rate", rate)


def uniform(key: Column, seed: int, part: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), part.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(mean: Column, u: Column) -> Column:
    """Inverse of the distribution function: the least k whose cumulated probability exceeds u."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.lit(0).alias("k"))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] * mean / i.cast("double")
        return F.when(state["total"] > u, state).otherwise(F.struct(
            term.alias("term"), (state["total"] + term).alias("total"), (state["k"] + 1).alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda state: state["k"])


def copies(mean: Column, key: Column, seed: int) -> Column:
    """Poisson number of the given mean, as the sum of ceil(mean / STEP) independent ones."""
    parts = F.greatest(F.lit(1), F.ceil(mean / STEP).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0),
                       lambda total, part: total + poisson(mean / parts, uniform(key, seed, part)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, seed: int = SEED,
        copy: str | None = None) -> DataFrame:
    """The rows of ``docs`` as often as they are to occur, dealt to partitions and ordered there by a random key.

    copy: name of a further column that numbers the occurrences of a row from 1.
    """
    own, key, source, rate, n, nth, place, deal, salt = free_names(
        docs, "own_source", "row_key", "rated_source", "rate", "occurrences", "nth", "place", "deal", "salt")
    of_source = rates(docs, weights, default_weight).select(F.col("source_key").alias(source), F.col("rate").alias(rate))
    rows = docs.withColumns({own: F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("null")), key: row_key(docs)})
    if of_source.count() <= MOST_SOURCES:
        joined = rows.join(F.broadcast(of_source), F.col(own) == F.col(source))
    else:
        salted = of_source.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(deal, F.pmod(F.hash(key), F.lit(SALTS))).join(
            salted, (F.col(own) == F.col(source)) & (F.col(deal) == F.col(salt)))
    repeated = joined.withColumn(n, copies(F.col(rate), F.col(key), seed)).filter(F.col(n) > 0).withColumn(
        nth, F.explode(F.sequence(F.lit(1), F.col(n))))
    dealt = repeated.withColumn(place, F.xxhash64(F.lit(seed), key, nth))
    return dealt.repartition(place).sortWithinPartitions(place, key, nth).select(
        *docs.columns, *([F.col(nth).alias(copy)] if copy else []))


def digest(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0) -> DataFrame:
    """The mixed corpus: doc_id, lang, source, n_chars, text, copy."""
    return mix(docs.select("doc_id", "lang", "source", "n_chars", "text"), weights, default_weight, copy="copy")


#: DuckDB: the result of digest() with equal weights.
SQL = f"""
WITH RECURSIVE sizes AS (
    SELECT coalesce('=' || source, 'null') AS k, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY 1),
rates AS (
    SELECT k, CASE WHEN chars = 0 THEN 1.0 ELSE 1.0::DOUBLE * (SELECT sum(chars) FROM sizes)::DOUBLE
                   / ((SELECT count(*) FROM sizes)::DOUBLE * chars::DOUBLE) END AS rate FROM sizes),
parts AS (SELECT k, greatest(1, ceil(rate / {STEP}))::INT AS parts, rate / greatest(1, ceil(rate / {STEP})) AS mean FROM rates),
terms(k, n, term, total) AS (
    SELECT k, 0, exp(-mean), exp(-mean) FROM parts
    UNION ALL
    SELECT t.k, n + 1, term * mean / (n + 1), total + term * mean / (n + 1) FROM terms t JOIN parts USING (k) WHERE n < {TERMS}),
draws AS (
    SELECT DISTINCT doc_id, coalesce('=' || source, 'null') AS k, part,
           ('0x' || substr(md5('{SEED}:' || doc_id || ':' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM documents JOIN parts ON k = coalesce('=' || source, 'null'), unnest(generate_series(1, parts.parts)) AS s(part)),
numbers AS (SELECT doc_id, count(*) AS n FROM draws JOIN terms ON draws.k = terms.k AND terms.total <= draws.u GROUP BY doc_id)
SELECT doc_id, lang, source, n_chars, text, copy::INT AS copy
FROM documents JOIN numbers USING (doc_id), unnest(generate_series(1, n)) AS c(copy)
"""
