"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled text is a sample of all documents of the training folds, with a label row or
without one, and no label of theirs is looked at. A linear classifier over the presence of words is trained in numpy by the non-negative,
class-prior-corrected risk estimator: the risk of the unlabelled rows as negatives, less the part that positives among them
account for, is not let fall below 0.

The class prior is estimated from the positives and the unlabelled rows, as label rows may be picked with toxic ones in mind: classifiers of
positives against unlabelled rows, each scoring the half that it wasn't trained on, give the least ratio of the shares
of both that score above a limit, at the limit where the ratio's confidence bound is least. The toxic share of label rows bounds it.

The classifier is fitted on a bounded sample: rows whose hash falls under a share that ``max_positive`` and ``max_unlabelled``
give from the counts of all rows, so no task sorts or holds more than its own, and ``max_words`` words. Scoring covers every row and
every text in full.

Defined results: a null or empty text has no words and gets the score of the bias alone. Without any positive training row
the score is 0 for every text. Rows are scored one by one; repeated label rows of a document count once, as toxic if
any of them is; a null id is never held out, nor learned from. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import drop_table, materialize

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    max_positive: int = 20_000
    max_unlabelled: int = 40_000
    #: Features are words and word stems (first letters) that so many positive documents hold and whose holders are positive
    #: at a rate of min_purity or more by the class prior's estimate; the most telling ones first.
    stems: tuple[int, ...] = (3, 4, 5, 6)
    min_documents: int = 5
    min_purity: float = 0.4
    max_words: int = 2048
    epochs: int = 2000
    #: For the prior: rounds, and by how many standard deviations the positives that hold a word exceed chance.
    prior_epochs: int = 300
    clear: float = 4.0
    rate: float = 0.05
    l2: float = 1e-3
    #: Folds by crc32 of the id; fold 0 of five is never learned from.
    folds: int = 5


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float
    stems: tuple[int, ...] = ()

    def margin(self, text: str | None, seen: dict[str, tuple[int, ...]] | None = None) -> float:
        """seen: features of words met before, kept up to a bound."""
        seen = {} if seen is None else seen
        words = set(WORD.findall((text or "").lower()))
        found: set[int] = set()
        for w in words:
            own = seen.get(w)
            if own is None:
                if len(seen) >= 400_000:
                    seen.clear()
                own = seen[w] = self._features(w)
            if own:
                found.update(own)
        return self.bias + float(self.weights[sorted(found)].sum())

    def _features(self, w: str) -> tuple[int, ...]:
        return tuple(self.words[f] for f in (w + "$", *(w[:n] for n in self.stems if len(w) >= n)) if f in self.words)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % folds) == 0, F.lit(False))


def nn_pu(p: list[np.ndarray], u: list[np.ndarray], n_words: int, prior: float | None, t: Training) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative PU risk with logistic loss, by Adam on all rows. p, u: each row's word numbers. Without
    a prior, of the plain risk that tells p from u."""

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)

    sets = [flat(p), flat(u)]
    w, b = np.zeros(n_words), 0.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)

    def slope(k: int, y: int) -> tuple[float, np.ndarray]:
        """Mean logistic loss of set k taken as label y, and its gradient."""
        words, rows, n = sets[k]
        z = y * (np.bincount(rows, w[words], n) + b)
        d = -y / (1 + np.exp(np.clip(z, -50, 50))) / n
        return float(np.logaddexp(0, -z).mean()), np.append(np.bincount(words, d[rows], n_words), d.sum())

    for step in range(1, t.epochs + 1):
        (_, g_pos), (r_neg, g_neg), (r_unl, g_unl) = slope(0, 1), slope(0, -1), slope(1, -1)
        if prior is None:
            g = 0.5 * g_pos + 0.5 * g_unl
        elif r_unl - prior * r_neg >= 0:
            g = prior * g_pos + g_unl - prior * g_neg
        else:  # the estimate went below 0: step back along it
            g = prior * g_neg - g_unl
        g[:-1] += t.l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def class_prior(p: list[np.ndarray], u: list[np.ndarray], n_words: int, most: float, t: Training) -> float:
    """Share of positives among the rows u, ``most`` at most."""
    if min(len(p), len(u)) < 4:
        return most
    plain = replace(t, epochs=t.prior_epochs)
    scores: list[list[float]] = [[], []]
    for half in (0, 1):
        w, _ = nn_pu(p[half::2], u[half::2], n_words, None, plain)
        for own, rows in zip(scores, (p[1 - half :: 2], u[1 - half :: 2])):
            own += [float(w[r].sum()) for r in rows]
    a, b = (np.sort(np.array(x)) for x in scores)
    limits = np.unique(a)
    above_p, above_u = (1 - np.searchsorted(x, limits) / len(x) for x in (a, b))
    doubt = sum(np.sqrt(np.log(4 / 0.1) / (2 * len(x))) for x in (a, b))
    best = int(np.argmin((above_u + doubt) / above_p))
    return float(min(most, max(above_u[best] / above_p[best], 1 / len(u))))


def _share(most: int, n: int, seed: int) -> Column:
    """Does a row belong to a sample of about ``most`` of n rows, by the hash of its id?"""
    if n <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30))


def fit(documents: DataFrame, labels: DataFrame, t: Training | None = None) -> Model:
    """Of labels, toxicity of training rows is read; of documents, ids and texts."""
    t = t or Training()
    truth = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), t.folds)).groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = truth.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    prior = known["p"] / known["n"] if known["n"] else 0.0
    own = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), t.folds))
    n_own = own.count()
    # About max_positive rows at most: broadcast.
    positive = truth.where(F.col("toxic") == 1).where(_share(t.max_positive, known["p"], 1)).select("doc_id", F.lit(True).alias("p"))
    flagged = own.withColumn("u", _share(t.max_unlabelled, n_own, 2)).join(F.broadcast(positive), "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(False)))
    # Copies of a text would make its words look telling: each text counts once.
    once = flagged.where("p OR u").withColumn("text", F.coalesce("text", F.lit(""))).groupBy("text").agg(F.max("p").alias("p"), F.max("u").alias("u"), F.min("doc_id").alias("doc_id"))
    texts = once.repartition(documents.sparkSession.sparkContext.defaultParallelism, "doc_id")
    texts = materialize(texts.mapInArrow(_features_of(t.stems), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, p boolean, u boolean, words array<string>"))
    n_p, n_u = texts.agg(F.count_if("p"), F.count_if("u")).first()
    if not n_p or not n_u:
        return Model({}, np.zeros(0), -50.0, prior)
    by = texts.select("p", "u", F.explode("words").alias("w")).groupBy("w").agg(F.count_if("p").alias("np"), F.count_if("u").alias("nu"))
    gain = F.log((F.col("np") + 0.5) / n_p) - F.log((F.col("nu") + 0.5) / n_u)
    purity = prior * (F.col("np") / n_p) / (F.col("nu") / n_u)
    top = by.where((F.col("np") >= min(t.min_documents, n_p)) & ((F.col("nu") == 0) | (purity >= t.min_purity))).withColumn("g", F.abs(gain) * F.sqrt("np")).orderBy(F.desc("g"), "w").limit(t.max_words)
    listed = top.select("w", "np", "nu").collect()
    vocabulary = {r["w"]: i for i, r in enumerate(listed)}
    known = documents.sparkSession.createDataFrame([(w, i) for w, i in vocabulary.items()] or [("", 0)], "w string, i int")
    rows = texts.select("doc_id", "p", "u", F.explode("words").alias("w")).join(F.broadcast(known), "w").groupBy("doc_id", "p", "u").agg(F.sort_array(F.collect_set("i")).alias("i")).orderBy("doc_id").collect()
    drop_table(texts)
    sets = []
    for flag, n in (("p", n_p), ("u", n_u)):
        found = [np.array(r["i"], np.int64) for r in rows if r[flag]]
        sets.append(found + [np.zeros(0, np.int64)] * (n - len(found)))
    n, seen = np.array([r["np"] for r in listed], float), np.maximum(1, np.array([r["nu"] for r in listed], float))
    by_chance = n_p * seen / n_u
    clear = n - by_chance >= t.clear * np.sqrt(by_chance)
    prior = class_prior(*_only(sets, clear), int(clear.sum()), prior, t) if clear.any() else prior
    # What the prior's upper bound let in goes if the estimate doesn't.
    pure = prior * (n / n_p) / (seen / n_u) >= t.min_purity
    sets, place = _only(sets, pure), np.cumsum(pure) - 1
    vocabulary = {w: int(place[i]) for w, i in vocabulary.items() if pure[i]}
    weights, bias = nn_pu(*sets, len(vocabulary), prior, t)
    return Model(vocabulary, weights, bias, prior, t.stems)


def _only(sets: list[list[np.ndarray]], kept: np.ndarray) -> list[list[np.ndarray]]:
    """Rows with the word numbers that are kept, numbered anew."""
    place = np.cumsum(kept) - 1
    return [[place[r[kept[r]]] for r in rows] for rows in sets]


def features(text: str | None, stems: tuple[int, ...]) -> list[str]:
    """Words, marked by a dollar sign, and word stems that a text holds."""
    words = set(WORD.findall((text or "").lower()))
    return sorted({w + "$" for w in words} | {w[:n] for n in stems for w in words if len(w) >= n})


def _features_of(stems: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, p, u, doc = batch.columns
            yield pa.RecordBatch.from_arrays([doc, p, u, pa.array([features(x, stems) for x in text.to_pylist()], pa.list_(pa.string()))], ["doc_id", "p", "u", "words"])

    return run


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            z = np.array([shared.value.margin(x, seen) for x in batch.column(0).to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select("text", *keep).mapInArrow(run, f"{fields}, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, t: Training | None = None) -> DataFrame:
    t = t or Training()
    out = score(documents, fit(documents, labels, t))
    return out.select("doc_id", held_out(F.col("doc_id"), t.folds).alias("held_out"), "score", "predicted")
