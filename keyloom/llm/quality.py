"""Quality by hierarchical empirical Bayes.

A classifier of a document's own form gives its evidence. What the documents of
a host, and of a path below it, are like is shrunk towards what lies above: a
path's rate towards its host's, a host's towards the global one, by strengths
that the spread between them tells (method of moments). A document's posterior
is its evidence with its path's rate as prior; its own evidence is left out of
that rate, and of the host's and the global rate behind it. Only the two
strengths, one number each for the whole corpus, are told from all documents.
Hosts and paths stay in DataFrames; only sums reach the driver.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, join_uneven, written

#: Bound of the labelled sample that the classifier is fitted on.
MAX_LABELLED = 20_000
#: A rate above counts for so many documents at least: a site of one page is never judged by that page alone.
LEAST_STRENGTH = 1.0

_SYMBOLS, _UPPER, _DIGITS = b"$%#*&!|@^~=<>{}[]\\_+", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
FEATURES = ("words", "length", "repeats", "distinct", "symbols", "pipes", "upper", "digits", "flat")


def features(text: bytes) -> list[float]:
    """Of a text in UTF-8: size, repetition, and what kinds of characters it has."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda which: (len(text) - len(text.translate(None, which))) / chars
    symbols, upper = share(_SYMBOLS), share(_UPPER)
    return [
        np.log1p(n), (chars - n) / n, np.sqrt(sum(map(operator.eq, words, words[1:])) / n), len(set(words)) / n ** 0.75, np.sqrt(symbols), np.sqrt(share(b"|")), np.sqrt(upper), np.sqrt(share(_DIGITS)),
        float(n < 12),
    ]


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, and ``x``, the features of the whole text."""
    frame = docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name != "text") + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py() or b"") for t in b.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], x], [*keep, "x"])

    return frame.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights with the bias last, means and scales, from at most about ``MAX_LABELLED`` rows of ``labels(doc_id, quality)``.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from, chosen
    by a hash of doc_id. Without labels of both kinds the evidence is 0.
    """
    known = labels.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    n = known.count()
    if n > MAX_LABELLED:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * MAX_LABELLED / n))
    chosen = written(known, "labelled")
    rows = _featured(join_checked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen, "doc_id", "inner"), ["y"]).toArrow()
    d = len(FEATURES)
    y = rows["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return np.zeros(d + 1), np.zeros(d), np.ones(d)
    x = np.array(rows["x"].to_pylist(), float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _expanded((x - mean) / scale)
    order = np.lexsort(np.column_stack([z, y]).T)  # the result doesn't depend on the order of rows
    z, y = z[order], y[order]
    w = np.zeros(z.shape[1])
    for _ in range(60):  # Newton's steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-2 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, scale


def _expanded(z: np.ndarray) -> np.ndarray:
    """Standard scores, their squares, bounded, and the bias."""
    z = np.clip(z, -8, 8)
    return np.column_stack([z, z * z / 4, np.ones(len(z))])


def evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs and ``evidence``, the classifier's log odds of good quality."""
    w, mean, scale = model
    frame = docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name != "text") + ", evidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or b"") for t in b.column(len(keep))], float).reshape(-1, len(FEATURES))
            e = _expanded((x - mean) / scale) @ w if len(w) > len(FEATURES) + 1 else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.clip(e, -12, 12), pa.float64())], [*keep, "evidence"])

    return frame.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _weight(groups: DataFrame, above: Column) -> float:
    """What one document weighs beside the rate above: one over its strength, by the spread of ``s / n`` around it beyond chance.

    0, which is a boundless strength, where no spread beyond chance is seen.
    """
    usable = groups.filter("n >= 2")
    rate = F.col("s") / F.col("n")
    got = usable.agg(F.sum("n"), F.sum(F.col("n") * F.pow(rate - above, 2)), F.sum(above * (1 - above)), F.sum(F.col("n") * above * (1 - above)), F.count("*")).collect()[0]
    n, spread, chance, full, k = (float(v or 0) for v in got)
    if k < 2 or full <= 0 or n <= k:
        return 0.0
    between = max(0.0, (spread - chance) / n) / (full / n)  # variance between groups, as a share of the greatest possible
    return between / (1 - between) if between < 1 / (1 + LEAST_STRENGTH) else 1 / LEAST_STRENGTH


def _shrunk(s: Column, n: Column, above: Column, weight: float) -> Column:
    """The rate of ``n`` documents whose probabilities sum up to ``s``, towards the rate above."""
    return (weight * s + above) / (weight * n + 1)


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, score, keep`` for every row of ``docs``.

    host and path default to the columns source and lang, path below host; nulls
    count as empty names. keep holds where the score, the posterior probability
    of good quality, is at least ``threshold``. host_rate and path_rate are what
    the other documents tell: a host's only document has the global rate as its
    host's. Null and empty texts have the evidence of no words; repeated rows
    count as they stand, each beside the others; a table of one row has the
    global rate 0.5; an empty table gives no rows. Other columns are not read.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name(host if host is not None else F.col("source")).alias("host"), name(path if path is not None else F.col("lang")).alias("path"), "text")
    rows = written(evidence(docs, fit(docs, labels), ["doc_id", "host", "path"]).withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    paths = written(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "hosts")
    s, n = (float(v or 0) for v in hosts.agg(F.sum("s"), F.sum("n")).collect()[0])
    mean = s / n if n else 0.5
    wide = _weight(hosts, F.lit(mean))
    above = paths.join(hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n")), "host")
    deep = _weight(above, _shrunk(F.col("host_s"), F.col("host_n"), F.lit(mean), wide))
    sums = written(above.select("host", "path", "n", "s", F.col("n").alias("m"), "host_s", "host_n"), "rates")
    out = join_uneven(rows, sums, ["host", "path"], int(n))
    p = F.col("p")
    others = (F.lit(s) - p) / (n - 1) if n > 1 else F.lit(0.5)
    out = out.withColumn("mean_rate", others).withColumn("host_rate", _shrunk(F.col("host_s") - p, F.col("host_n") - 1, F.col("mean_rate"), wide))
    out = out.withColumn("path_rate", _shrunk(F.col("s") - p, F.col("m") - 1, F.col("host_rate"), deep))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.col("mean_rate")))))
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; rows without a doc_id stay."""
    gone = quality(docs, labels, threshold=threshold).filter("not keep").select("doc_id").distinct()
    return join_checked(docs, written(gone, "gone"), "doc_id", "left_anti")
