"""Toxicity by a weighted finite-state pattern grammar.

Two transducers are composed.  The first reads words and writes classes: insult and threat (with a weight),
target (who is addressed), negation, reporting verb, clause end.  The second reads classes clause by clause and
writes matches: an insult or threat that is plain, aimed at a target, negated, or reported speech.  What is
scored is the matches of the clauses, with their weights, by a small logistic model; a word counts as far as
its clause says it does.

The lexicon is a fixed list of insults and threats in four languages together with words and word beginnings
learned from labelled texts; their weights are smoothed log odds of occurring in toxic texts.  Learning uses
labelled rows that are not held out (crc32 of the doc_id as text, modulo 5, is not 0), at most SAMPLE of them
(the first by a hash of doc_id) and keeps at most LEXICON entries; both bounds are parameters and the only
thing that is bounded.  Three of the four remaining folds give the lexicon, the fourth the logistic model.
Scores depend on the text alone.

Rows: null text is empty and scored; rows that repeat get equal scores; a text of any length is read whole;
labels that are null or belong to no row are ignored; without any usable label the fixed lexicon and fixed
coefficients score; a row without doc_id is scored and never held out; an empty table gives an empty result.
"""
from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, text_of

FOLDS = 5
SAMPLE = 20_000
LEXICON = 4_000
#: A learned entry occurs in so many toxic texts at least, and its log odds reach LEAST_WEIGHT.
LEAST_TEXTS = 3
LEAST_WEIGHT = 3.0
BEGINNINGS = range(3, 8)
FIXED_WEIGHT = 5.0
#: Coefficients when there is nothing to learn from: intercept, then one per kind of match.
DEFAULT = (-3.0, 2.0, 2.2, 0.2, 0.3)

#: Word lists of the grammar.
INSULTS = frozenset("""
idiot idiots moron morons stupid worthless pathetic loser losers scum trash clown clowns disgusting imbecile imbeciles dumb
dumbass bastard bastards asshole assholes bitch jerk jerks creep vermin filth retard retarded cretin
idioten dumm dummkopf blöd blödmann wertlos abschaum arschloch trottel depp versager widerlich
idiote idiotes stupide imbécile imbéciles minable ordure connard connasse salaud crétin débile
idiotas estúpido estúpida imbécil inútil basura patético asqueroso cabrón gilipollas payaso
""".split())
THREATS = frozenset("""kill destroy hurt beat murder shoot stab töten umbringen vernichten tuer détruire frapper matar destruir
golpear""".split())
TARGETS = frozenset("""you your yours u ya they them their people he she him her everyone du dich dir dein deine ihr euch sie tu te toi
ton vous votre ils elles usted ustedes tú ti vosotros ellos""".split())
NEGATIONS = frozenset("""not no never don't isn't aren't wasn't nicht kein keine nie niemals ne pas jamais aucun aucune nunca jamás
ningún""".split())
REPORTS = frozenset("""said says wrote writes claimed claims called reported quoted told sagte sagt schrieb behauptet nannte dit disait
écrit affirme dijo dice escribió afirma llamó""".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
PLAIN, AIMED, NEGATED, REPORTED = range(4)
_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
_REACH, _BACK = 3, 2


class Lexicon(dict):
    """The first transducer: word -> (class, weight).  Learned words and beginnings are looked up once per word."""

    LIMIT = 100_000

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        super().__init__()
        self.learned_words, self.learned_beginnings = words, beginnings

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > self.LIMIT:
            self.clear()
        weight = self.learned_words.get(word, 0.0)
        for n in BEGINNINGS:
            if n <= len(word):
                weight = max(weight, self.learned_beginnings.get(word[:n], 0.0))
        if word in INSULTS:
            found = (INSULT, max(weight, FIXED_WEIGHT))
        elif weight:
            found = (INSULT, weight)
        elif word in THREATS:
            found = (THREAT, FIXED_WEIGHT)
        else:
            found = (TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS
                     else END if word in ".!?;\n" else OTHER, 0.0)
        self[word] = found
        return found


def _grammar() -> dict[tuple, tuple]:
    """The second transducer: (state, class) -> (state, match or None, whether the match before is aimed, match of the
    threat that waits or None).

    State: words left in which a negation and a target reach on, words left in which a target reaches back,
    whether the clause reports speech, words left in which a threat waits for its target, and the kind of
    match that it becomes then.
    """
    steps = {}
    waits = [(0, PLAIN), *((left, kind) for left in range(1, _REACH + 1) for kind in (AIMED, NEGATED, REPORTED))]
    for negation, target, back, reports, (wait, waiting) in itertools.product(
            range(_REACH + 1), range(_REACH + 1), range(_BACK + 1), (False, True), waits):
        state = (negation, target, back, reports, wait, waiting)
        n, t, b = max(negation - 1, 0), max(target - 1, 0), max(back - 1, 0)
        w = (wait - 1, waiting) if wait > 1 else (0, PLAIN)
        kind = REPORTED if reports else NEGATED if negation else AIMED if target else PLAIN
        # A threat needs somebody it is aimed at, before it or after it.
        threat, waits_on = (kind, w) if target else (None, (_REACH, AIMED if kind == PLAIN else kind))
        steps[state, OTHER] = ((n, t, b, reports, *w), None, False, None)
        steps[state, INSULT] = ((n, t, _BACK if kind == PLAIN else 0, reports, *w), kind, False, None)
        steps[state, THREAT] = ((n, t, 0, reports, *waits_on), threat, False, None)
        steps[state, TARGET] = ((n, _REACH, 0, reports, 0, PLAIN), None, back > 0, waiting if wait else None)
        steps[state, NEGATION] = ((_REACH, t, b, reports, *w), None, False, None)
        steps[state, REPORT] = ((n, t, b, True, *w), None, False, None)
        steps[state, END] = (_START, None, False, None)
    return steps


_START = (0, 0, 0, False, 0, PLAIN)
GRAMMAR = _grammar()


def tokens(text: str) -> list[str]:
    return _TOKENS.findall(text.lower())


def matches(text: str, lexicon: Lexicon) -> np.ndarray:
    """Summed weights of the plain, aimed, negated and reported matches of a text."""
    totals = [0.0, 0.0, 0.0, 0.0]
    classes = [lexicon[t] for t in tokens(text)]
    if not any(weight for _, weight in classes):
        return np.zeros(4)
    state, last, held = _START, 0.0, 0.0
    for kind, weight in classes:
        waited = state[4] > 0
        state, match, aims, late = GRAMMAR[state, kind]
        if late is not None:
            totals[late] += held
        elif kind == THREAT and match is None:
            held = held + weight if waited else weight
        if match is not None:
            totals[match] += weight
            last = weight
        elif aims:
            totals[PLAIN] -= last
            totals[AIMED] += last
    return np.array(totals)


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = DEFAULT

    def score(self, text: str, lexicon: Lexicon) -> float:
        x = np.log1p(matches(text, lexicon))
        z = self.coefficients[0] + float(np.dot(self.coefficients[1:], x))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def _entries(text: str) -> set[str]:
    """Words ("=word") and word beginnings ("^begin") of a text."""
    out = set()
    for word in set(tokens(text)):
        if len(word) > 1:
            out.add("=" + word)
            out.update("^" + word[:n] for n in BEGINNINGS if n <= len(word))
    return out


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    for batch in batches(parts):
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            (toxic if label else clean).update(_entries(text))
    # Only entries of toxic texts can enter the lexicon; others are sent for their clean counts all the same.
    keys = list(toxic.keys() | clean.keys())
    for at in range(0, len(keys), 100_000):
        part = keys[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()),
                                          pa.array([clean[k] for k in part], pa.int64())], ["entry", "toxic", "clean"])


def sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, toxic, fold) of at most ``limit`` labelled rows that are not held out, one of equal texts."""
    known = labels.select(labels["doc_id"].alias("_id"), labels["toxic"].cast("int").alias("toxic")).filter(
        "_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn(
        "fold", fold(F.col("_id"))).filter("fold <> 0")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(docs["doc_id"].alias("_doc"), text_of(docs).alias("text"))
    # at most ``limit`` ids of a few bytes: small by construction, so no text is shuffled to find them
    return rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("text").agg(
        F.max("toxic").alias("toxic"), F.min("fold").alias("fold"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients by Newton steps, drawn towards DEFAULT where few texts tell; x has a leading column of ones."""
    prior = np.array(DEFAULT)
    beta, shrink = prior.copy(), np.full(x.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        gradient = x.T @ (y - p) - shrink * (beta - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, entries: int = LEXICON) -> Model:
    """Lexicon and coefficients from a bounded sample of the labelled rows."""
    from sourceloom.llm.common import store
    rows = store(sample(docs, labels, limit))
    sizes = {r["toxic"]: r["n"] for r in rows.filter("fold <> 4").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model()
    # The sample is small, but long texts take their time: deal it to all cores.
    dealt = rows.filter("fold <> 4").select("text", "toxic").repartition(F.xxhash64("text"))
    counted = dealt.mapInArrow(_counts, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    found = counted.withColumn("w", weight).filter((F.col("t") >= LEAST_TEXTS) & (F.col("w") >= LEAST_WEIGHT)).orderBy(
        F.desc(F.col("w") * F.sqrt("t")), "entry").limit(entries).collect()
    words = {r["entry"][1:]: r["w"] for r in found if r["entry"][0] == "="}
    beginnings = {r["entry"][1:]: r["w"] for r in found if r["entry"][0] == "^"}

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, beginnings)
        for batch in batches(parts):
            x = np.array([matches(t, lexicon) for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(4)], batch["toxic"]], ["a", "b", "c", "d", "toxic"])
    held = rows.filter("fold = 4").select("text", "toxic").repartition(F.xxhash64("text")).mapInArrow(
        measure, "a double, b double, c double, d double, toxic int").collect()
    y = np.array([r["toxic"] for r in held], float)
    if not len(y) or y.min() == y.max():
        return Model(words, beginnings)
    x = np.log1p(np.array([[r[k] for k in "abcd"] for r in held], float))
    beta = _logistic(np.column_stack([np.ones(len(y)), x]), y)
    return Model(words, beginnings, tuple(beta.tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.beginnings)
        for batch in batches(parts):
            scores = [model.score(t, lexicon) for t in batch["text"].to_pylist()]
            ids = batch["doc_id"].to_pylist()
            out = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(out, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    model = train(docs, labels)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.beginnings)
        for part in parts:
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield part.filter(pa.array([model.score(t or "", lexicon) < 0.5 for t in texts], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
