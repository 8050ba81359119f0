"""A counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings is fitted to labelled documents. Their sentences give counterfactual pairs,
PAIR_SENTENCES of them at most, those that name a group first: every identity term of a sentence is swapped for another (a
sentence without one gets one inserted), and each change of the logit between the two is penalised, so that naming a group
moves no score. NEUTRAL holds short sentences labelled as not toxic that name each group once; they join the pairs, so that
swaps are there even where no labelled document names a group.

Fitting uses a bounded sample (SAMPLE_ROWS labelled rows, chosen by a hash of id and text); features and weights are a few
thousand numbers, which are broadcast. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import checkpoint, lean, load, slices, text_of, written

#: Labelled rows to fit on at most, features kept, rows of a feature at least, sentences for pairs.
SAMPLE_ROWS, FEATURES, FEATURE_ROWS, PAIR_SENTENCES = 20_000, 600, 5, 2000
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5, 6)
#: Neutral names of groups; swapping one for another must not change a score.
IDENTITY_TERMS = (
    "women men girls boys black white asian african european american arab jewish jews muslim muslims christian christians hindu "
    "buddhist atheist gay lesbian bisexual transgender queer straight immigrants refugees foreigners disabled blind deaf old young "
    "poor mexican german french spanish turkish polish russian chinese indian frauen männer juden muslime christen schwarze "
    "ausländer flüchtlinge behinderte femmes hommes juifs musulmans chrétiens noirs étrangers réfugiés handicapés mujeres hombres "
    "judíos musulmanes cristianos negros extranjeros refugiados discapacitados"
).split()
#: Neutral sentences about a group.
NEUTRAL = ("the {} met here today", "many {} live in this town", "I talked with the {} about their work", "this book is about {} and their history")
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings marked by a star."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in PREFIXES:
        found |= {w[:n] + "*" for w in words if len(w) >= n}
    return found


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self.words = {k for k in self.weights if not k.endswith("*")}
        self.starts = {n: {k[:-1] for k in self.weights if k.endswith("*") and len(k) == n + 1} for n in PREFIXES}

    def logit(self, text: str) -> float:
        words = set(_WORD.findall(text.lower()))
        z = self.bias
        for k in sorted(words & self.words):
            z += self.weights[k]
        for n, known in self.starts.items():
            for k in sorted(known.intersection([w[:n] for w in words])):
                z += self.weights[k + "*"]
        return z

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def sentences(text: str) -> list[str]:
    """The sentences of over two words, whole."""
    return [s.strip() for s in _SENTENCE.split(text) if len(s.split()) > 2]


def named(sentence: str, terms: frozenset[str] = frozenset(IDENTITY_TERMS)) -> list[int]:
    """Places of the words that are identity terms."""
    return [j for j, w in enumerate(sentence.split()) if w.lower().strip(".,;:!?\"'()") in terms]


def counterfactual_pairs(chosen: list[str], terms: list[str] = IDENTITY_TERMS, swaps: int = 3) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in identity terms only, all of a sentence's swapped. Which terms: by the sentence's position, so that all have their turn."""
    known = frozenset(terms)
    pairs = []
    for i, s in enumerate(chosen):
        words, at = s.split(), named(s, known)
        for j in range(swaps):
            other = lambda k, i=i, j=j: terms[(i * swaps + j + k) % len(terms)]
            swapped = list(words)
            for k, place in enumerate(at):
                swapped[place] = other(k)
            pairs.append((s, " ".join(swapped if at else [other(0), *words])))
    return pairs


def neutral_sentences() -> list[str]:
    return [NEUTRAL[i % len(NEUTRAL)].format(t) for i, t in enumerate(IDENTITY_TERMS)]


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, penalty: float = 5.0, ridge: float = 1e-4, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic loss + ridge + penalty x mean squared change of the logit over the pairs, by Adam on the full batch."""
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    moved = [(np.setdiff1d(b, a), np.setdiff1d(a, b)) for a, b in pairs]
    cols = np.concatenate([*(x for m in moved for x in m), np.zeros(0, np.int64)]).astype(np.int64)
    sign = np.concatenate([*(np.full(len(x), s) for m in moved for x, s in zip(m, (1.0, -1.0), strict=True)), np.zeros(0)])
    pair = np.repeat(np.arange(len(moved)), [len(a) + len(b) for a, b in moved])
    y = labels.astype(float)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh the same
    w, b = np.zeros(n), 0.0
    m, v, beta = np.zeros(n + 1), np.zeros(n + 1), (0.9, 0.999)
    for t in range(1, rounds + 1):
        z = b + np.bincount(of, w[flat], minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(flat, g[of], minlength=n) + ridge * w
        if len(moved):
            change = np.bincount(pair, sign * w[cols], minlength=len(moved))
            grad += 2 * penalty / len(moved) * np.bincount(cols, sign * change[pair], minlength=n)
        step = np.append(grad, g.sum())
        m, v = beta[0] * m + (1 - beta[0]) * step, beta[1] * v + (1 - beta[1]) * step**2
        move = 0.1 * (m / (1 - beta[0] ** t)) / (np.sqrt(v / (1 - beta[1] ** t)) + 1e-9)
        w, b = w - move[:n], b - move[n]
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, penalty: float = 5.0) -> Model:
    """Fit on the labelled documents. `labels` holds the rows to learn from only; of conflicting labels the largest counts, null labels and ids are left out.

    Rows that repeat an id and text count once, so no id can outgrow the sample.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = checkpoint(known)
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(sample_rows / n * (1 << 20)))
    # About sample_rows ids and labels, so broadcasting them is bounded.
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "text", "y").distinct()
    sample = written(rows.withColumn("key", F.xxhash64("id", "text")))
    if sample.count() > sample_rows:
        sample = sample.where(F.col("key") <= F.lit(sample.select("key").orderBy("key").limit(sample_rows).agg(F.max("key")).first()[0]))
    totals = sample.agg(F.count(F.when(F.col("y") > 0, 1)), F.count(F.when(F.col("y") <= 0, 1))).first()
    if not sum(totals):
        return Model(-5.0, {})

    def count(batches):
        seen: list[Counter] = [Counter(), Counter()]
        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y > 0].update(features(text))
        keys = list({**seen[0], **seen[1]})
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"f": pa.array(part, pa.string()), "neg": pa.array([seen[0][k] for k in part], pa.int64()), "pos": pa.array([seen[1][k] for k in part], pa.int64())})

    counts = sample.select("text", "y").mapInArrow(lean(count), "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (totals[0] + 1.0)) - F.log((F.col("neg") + 0.5) / (totals[1] + 1.0))
    rank = F.abs(odds) * F.sqrt(F.col("pos") + F.col("neg"))
    kept = [r.f for r in counts.where(F.col("pos") + F.col("neg") >= FEATURE_ROWS).orderBy(rank.desc(), "f").limit(FEATURES).select("f").collect()]
    own = sorted({f for t in (*IDENTITY_TERMS, *NEUTRAL) for f in features(t.replace("{}", ""))})
    index = {f: i for i, f in enumerate(dict.fromkeys([*kept, *own]))}

    def encode(batches):
        for batch in slices(batches):
            found = [sorted(index[f] for f in features(t) & index.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.list_(pa.int32())), "y": batch.column(1).cast(pa.int32()), "key": batch.column(2)})

    def cut(batches):
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                found = sentences(t)
                yield pa.RecordBatch.from_pydict({"s": pa.array(found, pa.string()), "named": pa.array([bool(named(s)) for s in found], pa.bool_())})

    def pair(batches):
        """The features that each pair's second sentence has beyond the first, and the other way round; one task, at most PAIR_SENTENCES sentences."""
        first = 0
        for batch in slices(batches):
            found = batch.column(0).to_pylist()
            made = counterfactual_pairs([""] * first + found)[3 * first :] if first else counterfactual_pairs(found)
            first += len(found)
            places = [tuple({index[f] for f in features(s) & index.keys()} for s in p) for p in made]
            yield pa.RecordBatch.from_pydict({"more": pa.array([sorted(b - a) for a, b in places], pa.list_(pa.int32())), "less": pa.array([sorted(a - b) for a, b in places], pa.list_(pa.int32()))})

    rows = sorted(sample.select("text", "y", "key").mapInArrow(lean(encode), "x array<int>, y int, key long").collect(), key=lambda r: (r.key, r.y, r.x))
    found = written(sample.select("text").mapInArrow(lean(cut), "s string, named boolean").distinct().withColumn("key", F.pmod(F.xxhash64("s"), F.lit(1 << 20))))
    n_named, n_other = found.agg(F.count_if("named"), F.count_if(~F.col("named"))).first()
    # Twice as many as are wanted, by hash, so that the task that puts them in order gets few more than it keeps.
    share = lambda want, n: int(min(1.0, 2 * want / max(1, n)) * (1 << 20))
    few = F.col("key") < F.when(F.col("named"), share(PAIR_SENTENCES, n_named)).otherwise(share(max(0, PAIR_SENTENCES - n_named), n_other))
    chosen = found.where(few).orderBy(F.desc("named"), "key", "s").limit(PAIR_SENTENCES).select("s")
    moved = [(np.array(r.more, np.int64), np.array(r.less, np.int64)) for r in chosen.mapInArrow(lean(pair), "more array<int>, less array<int>").collect()]
    place = lambda s: np.array(sorted(index[f] for f in features(s) & index.keys()), np.int64)
    neutral = [(place(a), place(b)) for a, b in counterfactual_pairs(neutral_sentences())]
    bias, w = fit_weights([np.array(r.x, np.int64) for r in rows], np.array([r.y > 0 for r in rows]), neutral + [(less, more) for more, less in moved], len(index), penalty)
    return Model(bias, {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts get the model's bias, repeated rows equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())})

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, score double")


def held_out(id_col: str = "doc_id"):
    """A fifth of the ids, by the CRC-32 of the id's text; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels that are not held out and score every document."""
    model = train(docs, labels.where(~held_out()).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic, with all their columns."""
    model = train(docs, load(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic"))
    return keep_clean(docs, model)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score below 0.5. Only the text goes to Python; the row's other columns stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shared.value.score(t) < 0.5).astype(bool)

    return docs.where(clean(text_of(text_col)))
