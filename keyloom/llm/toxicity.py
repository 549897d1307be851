"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words that a text has, and the beginnings of words, is
trained by numpy from confirmed toxic texts (P) and unlabelled ones (U). Its
risk is

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))

with the sigmoid loss; pi, the prior of the toxic class, comes from the labels
that may be learnt from. Nothing depends on how rows are dealt out: samples are
chosen by hashes, and the texts are put in an order of their own before
training. Where the second part would be negative, the step goes
against it instead, which keeps the model from overfitting P. Weights are not
negative: a word can speak for toxicity, but no number of harmless words speaks
against it, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, written
from .decontam import words_of

#: Bounds of the training sample, in texts, about: what the driver holds.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
#: Features of fewer sampled texts, or whose rates differ by fewer standard errors, are left out.
MIN_TEXTS, MIN_Z = 5, 4.0
#: Beginnings of words, in bytes, that are features besides the words; they are told from words by a "^".
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose features a worker remembers.
REMEMBERED = 300_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row's label may not be learnt from; a null doc_id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _some(rows: DataFrame, most: int, seed: int, n: int | None = None) -> DataFrame:
    """About ``most`` of the ``n`` rows, by a hash of doc_id and text, repeated ones once; all if there are no more."""
    n = rows.count() if n is None else n
    chosen = rows if n <= most else rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * most / n))
    return chosen.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "digest"]).drop("digest")


def features_of(words: set[bytes]) -> set[bytes]:
    """The words, and the beginnings of those that are longer."""
    return words | {b"^" + w[:k] for k in BEGINNINGS for w in words if len(w) > k}


def _distinct_words(texts: DataFrame) -> DataFrame:
    typed = pa.schema([("doc_id", pa.int64()), ("p", pa.int64()), ("words", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(features_of(set(words_of(t.as_py() or b"")))) for t in b.column(2)], typed.types[2])], schema=typed)

    return texts.mapInArrow(run, "doc_id long, p long, words array<binary>")


Texts = tuple[np.ndarray, np.ndarray, int]


def risk(w: np.ndarray, texts: Texts, mine: np.ndarray | None = None) -> tuple[float, float, np.ndarray]:
    """Mean losses of calling ``texts`` toxic and clean, and the gradient of the first; the second's is its negative.

    texts: pairs of a text's number and a word's, and how many texts there are;
    only those that ``mine`` marks count.
    """
    text, word, n = texts
    mine = np.ones(n, bool) if mine is None else mine
    take = mine[text]
    f = np.bincount(text[take], w[word[take]], minlength=n) + w[-1]
    s = 1 / (1 + np.exp(np.clip(f, -30, 30)))
    size = max(1, int(mine.sum()))
    slope = np.where(mine, -s * (1 - s), 0) / size
    gradient = np.append(np.bincount(word[take], slope[text[take]], minlength=len(w) - 1), slope.sum())
    return float((s * mine).sum() / size), float(((1 - s) * mine).sum() / size), gradient


def train(positive: Texts, unlabelled: Texts, words: int, prior: float, epochs: int = 200, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, that minimise the non-negative risk; sets as in ``risk``."""
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(words + 1), np.zeros(words + 1), np.zeros(words + 1)
    w[-1] = -1.0
    step = 0
    parts = 8
    for _ in range(epochs):
        deal = [rng.integers(0, parts, s[2]) for s in (positive, unlabelled)]
        for k in range(parts):
            _, p_clean, p_up = risk(w, positive, deal[0] == k)
            _, u_clean, u_up = risk(w, unlabelled, deal[1] == k)
            negative = u_clean - prior * p_clean
            up = -u_up + prior * p_up  # gradient of that
            grad = prior * p_up + up if negative >= 0 else -up
            grad = grad + decay * np.append(w[:-1], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)
    return w


def ordered(rows: list[list[int]]) -> Texts:
    """Texts, each as the words that it has, in an order that only they decide."""
    rows = sorted(sorted(r) for r in rows)
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), lengths), np.array([i for r in rows for i in r], np.int64), len(rows)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> tuple[dict[bytes, float], float]:
    """Weights of words, and the bias, from a bounded sample of ``docs`` and of ``labels(doc_id, toxic)``.

    P: about ``MAX_POSITIVE`` texts labelled 1 at most; U: about
    ``MAX_UNLABELLED`` texts of any row; both only of rows not held out, and
    chosen by a hash of doc_id and text, so that an id which is repeated takes
    no more room than others. The vocabulary is every feature that speaks
    clearly for P (``MIN_TEXTS``, ``MIN_Z``). Without a positive label all
    scores are 0.
    """
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).collect()[0]
    if not toxic:
        return {}, -30.0
    prior = toxic / n
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    marked = written(known.filter("toxic = 1").select("doc_id").distinct(), "toxic-ids")
    p = _some(written(join_checked(texts, marked, "doc_id", "left_semi"), "toxic-p"), MAX_POSITIVE, seed).withColumn("p", F.lit(1).cast("long"))
    whole = docs.select("doc_id").filter(~held_out()).count()
    u = _some(texts.filter(~held_out()), MAX_UNLABELLED, seed + 1, whole).withColumn("p", F.lit(0).cast("long"))
    rows = written(_distinct_words(p.unionByName(u).select("doc_id", "p", "text")), "toxic-words")
    sizes = {r.p: r.n for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0) or 1, sizes.get(0, 0) or 1
    counts = rows.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b"))
    rate = (F.col("a") + F.col("b")) / (n_p + n_u)
    z = (F.col("a") / n_p - F.col("b") / n_u) / F.sqrt(rate * (1 - F.least(rate, F.lit(0.999))) * (1 / n_p + 1 / n_u))
    number = {x: i for i, x in enumerate(sorted(bytes(r.word) for r in counts.filter(F.col("a") + F.col("b") >= MIN_TEXTS).filter(z >= MIN_Z).select("word").collect()))}
    if not number:
        return {}, -30.0
    sent = rows.sparkSession.sparkContext.broadcast(number)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([[i for x in ws if (i := get(x)) is not None] for ws in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["p", "at"])

    table = rows.mapInArrow(index, "p long, at array<int>").toArrow()
    positive, unlabelled = (ordered(table.filter(pa.compute.equal(table["p"], kind))["at"].to_pylist()) for kind in (1, 0))
    w = train(positive, unlabelled, len(number), prior)
    return {x: float(w[i]) for x, i in number.items()}, float(w[-1])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    The score, 0 to 1, is of the whole text's words alone. Null and empty texts
    have the score of no words, below 0.5; repeated rows the same score; without
    a label that may be learnt from all scores are 0. An empty table gives no
    rows. Other columns are not read.
    """
    weights, bias = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        remembered: dict[bytes, tuple[bytes, ...]] = {}

        def known(word: bytes) -> tuple[bytes, ...]:
            if (got := remembered.get(word)) is None:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                got = remembered[word] = tuple(x for x in features_of({word}) if x in weight)
            return got

        for b in batches:
            f = np.array([bias + sum(sorted(weight[x] for x in {x for w in set(words_of(t.as_py() or b"")) for x in known(w)})) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(f, -30, 30))), pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
