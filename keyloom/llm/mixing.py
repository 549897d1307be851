"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token
weights are raked until each marginal has its target shares; documents are then
sampled by the probabilities that this calibrates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_checked, text_or_empty, written

#: Bound of the cells that are raked on the driver. More are raked as a table, to the same targets, with the same weights.
MAX_CELLS = 100_000
#: Rounds of raking at most, and the difference of shares that is a fit. What difference is left is told in ``mix_error``.
ROUNDS, WITHIN = 2_000, 1e-10

#: Topics by the form of a text: the first whose pattern is found. ``mix`` takes another column of topics.
TOPICS = (
    ("table", r"\|"),
    ("licence", r"(?i)licen[cs]ed? |copyright"),
    ("code", r"[{};]\n|\b\w+ = [\"0-9]|def |function "),
    ("markup", r"[#*$%&]{3}"),
)


@dataclass(frozen=True)
class Mix:
    """Targets. A marginal is a dict of shares, or an exponent: shares by tokens to that power.

    Categories that a dict doesn't name share what it leaves, by tokens; if it
    leaves nothing they get nothing. ``budget``: expected tokens, as a multiple
    of those there are; a document may be drawn more than once.
    """

    source: dict[str, float] | float = 0.7
    lang: dict[str, float] | float = 0.7
    topic: dict[str, float] | float = 0.9
    budget: float = 1.0
    seed: int = 17


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    bare = F.trim(F.translate(text, "\t\n\r", "   "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " +"))).cast("long")


def targets(shares: dict[str, float] | float, names: list[str], tokens: np.ndarray) -> np.ndarray:
    """The target share of each category that there is, in all 1."""
    if not isinstance(shares, dict):
        t = np.where(tokens > 0, np.maximum(tokens, 1e-300) ** shares, 0.0)
    else:
        named = np.array([shares.get(n, -1.0) for n in names])
        rest = max(0.0, 1 - sum(shares.values()))
        free = np.where(named < 0, tokens, 0.0)
        t = np.where(named < 0, rest * free / (free.sum() or 1), named)
    return t / t.sum() if t.sum() > 0 else t


def rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], rounds: int = ROUNDS, within: float = WITHIN) -> np.ndarray:
    """Shares of the cells whose marginals are ``goals``, by iterative proportional fitting from ``tokens``.

    Where zero cells leave no exact fit, the last round's shares, in all 1; ``fit_error`` tells how far off they are.
    """
    w = tokens / tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            have = np.bincount(code, w, minlength=len(goal))
            worst = max(worst, float(np.abs(have - goal).max()))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code]
        if worst < within:
            break
    return w / w.sum() if w.sum() > 0 else w


def fit_error(shares: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> float:
    """The largest difference of a marginal's share to its target."""
    return max((float(np.abs(np.bincount(c, shares, minlength=len(g)) - g).max()) for c, g in zip(codes, goals, strict=True)), default=0.0)


def goal_table(shares: dict[str, float] | float, tokens: DataFrame, dim: str) -> DataFrame:
    """``targets`` of ``tokens(dim, n)`` as a table ``dim, goal``."""
    if not isinstance(shares, dict):
        t = tokens.withColumn("t", F.pow(F.col("n").cast("double"), F.lit(float(shares))))
    else:
        named = tokens.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{dim} string, named double")
        t = join_checked(tokens, named, dim)
        rest = max(0.0, 1 - sum(shares.values()))
        free = t.filter("named is null").agg(F.sum("n")).first()[0] or 1
        t = t.withColumn("t", F.coalesce("named", F.lit(rest) * F.col("n") / F.lit(float(free))))
    t = written(t.select(dim, "t"), "targets")
    total = t.agg(F.sum("t")).first()[0] or 1.0
    return t.select(dim, (F.col("t") / F.lit(total)).alias("goal"))


def rake_table(cells: DataFrame, how: Mix, rounds: int = ROUNDS, within: float = WITHIN) -> tuple[DataFrame, float]:
    """``source, lang, topic, fitted`` and the ``fit_error`` of ``cells(source, lang, topic, n)``: ``rake`` and its weights where cells are too many for the driver.

    Each marginal is a grouped sum; only one number of each reaches the driver.
    Besides an exact fit, shares that a whole round leaves as they are end it.
    """
    dims = ("source", "lang", "topic")
    total = float(cells.agg(F.sum("n")).first()[0])
    goals = [goal_table(s, cells.groupBy(d).agg(F.sum("n").alias("n")), d) for d, s in zip(dims, (how.source, how.lang, how.topic), strict=True)]
    w = written(cells.select(*dims, "n", (F.col("n") / F.lit(total)).alias("w"), F.lit(0.0).alias("was")), "rake")
    for _ in range(rounds):
        worst = 0.0
        w = w.withColumn("was", F.col("w"))
        for d, goal in zip(dims, goals, strict=True):
            have = written(w.groupBy(d).agg(F.sum("w").alias("have")).join(goal, d), "marginal")
            worst = max(worst, have.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0])
            by = have.select(d, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("by"))
            w = join_checked(w, by, d).select(*dims, "n", (F.col("w") * F.col("by")).alias("w"), "was")
        w = written(w, "rake")
        if worst < within or w.agg(F.sum(F.abs(F.col("w") - F.col("was")))).first()[0] < within:
            break
    share = w.agg(F.sum("w")).first()[0] or 1.0
    off = [w.groupBy(d).agg(F.sum("w").alias("have")).join(goal, d).agg(F.max(F.abs(F.col("have") / F.lit(share) - F.col("goal")))).first()[0] for d, goal in zip(dims, goals, strict=True)]
    return w.select(*dims, (F.col("w") / F.lit(share) / (F.col("n") / F.lit(total))).alias("fitted")), float(max(off))


def mix(docs: DataFrame, how: Mix | None = None, topic: Column | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, rate, copies, mix_error`` for every row of ``docs(doc_id, text, source, lang)``.

    weight is the cell's fitted share over its share of tokens, rate the
    expected number of draws, copies the number drawn: the whole part of rate,
    and one more with the rest's probability, by a hash of doc_id. mix_error is
    how far the worst marginal stays from its target, the same in every row: 0
    or nearly so, or more where empty cells leave no exact fit. Nulls count
    as empty texts and names; a document without tokens has the rate of its
    cell, and of weight 1 where the cell has no tokens. Rows that repeat a
    doc_id share its draw. An empty table gives no rows. Other columns are not
    read, but for those of ``topic``, which is ``topic_of`` the text unless given. Cells are counted before they are collected: more than ``MAX_CELLS`` are
    raked as a table. Every source is a category of its own, however many.
    """
    how = how or Mix()
    text = text_or_empty()
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    topic = topic_of(text) if topic is None else name(topic)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), name(F.col("source")).alias("source"), name(F.col("lang")).alias("lang"), topic.alias("topic"), tokens_of(text).alias("n_tokens")), "tokens")
    spark = docs.sparkSession
    cells = written(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")), "cells")
    error = 0.0
    if cells.count() > MAX_CELLS:
        full = cells.filter("n > 0")
        if full.isEmpty():
            weights = full.selectExpr("source", "lang", "topic", "1D AS fitted")
        else:
            fitted, error = rake_table(full, how)
            weights = written(fitted, "weights")
    else:
        got = sorted(tuple(r) for r in cells.filter("n > 0").collect())
        fitted = []
        if got:
            tokens = np.array([r[3] for r in got], float)
            codes, goals = [], []
            for k, shares in enumerate((how.source, how.lang, how.topic)):
                names = sorted({r[k] for r in got})
                at = {n: i for i, n in enumerate(names)}
                codes.append(np.array([at[r[k]] for r in got]))
                goals.append(targets(shares, names, np.bincount(codes[-1], tokens, minlength=len(names))))
            raked = rake(tokens, codes, goals)
            error = fit_error(raked, codes, goals)
            fitted = [(*r[:3], float(w)) for r, w in zip(got, raked / (tokens / tokens.sum()), strict=True)]
        weights = F.broadcast(spark.createDataFrame(fitted, "source string, lang string, topic string, fitted double"))  # at most MAX_CELLS rows
    out = rows.join(weights, ["source", "lang", "topic"], "left")
    weight = F.coalesce("fitted", F.lit(1.0))
    rate = weight * how.budget
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(how.seed)), 11) / F.lit(float(2**53))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("weight", weight).withColumn("rate", rate).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "rate", copies.cast("long").alias("copies"), F.lit(error).alias("mix_error"))


def mixed(docs: DataFrame, how: Mix | None = None, topic: Column | None = None) -> DataFrame:
    """The documents drawn at least once, with all their columns and ``mix_weight, mix_rate, mix_copies``; rows without a doc_id are not drawn.

    An input's own columns of these names stay as they are: the added one then
    has underscores after its name. Rows that repeat a doc_id are drawn or not
    as one, by the greatest of their weights. The drawn ids are joined to the
    documents: a sample of a corpus is too large to broadcast.
    """
    names = [free_name(n, docs.columns) for n in ("mix_weight", "mix_rate", "mix_copies")]
    first = F.max(F.struct(*[F.col(c).alias(n) for c, n in zip(("weight", "rate", "copies"), names, strict=True)])).alias("m")
    drawn = mix(docs, how, topic).filter("copies > 0 and doc_id is not null").groupBy("doc_id").agg(first).select("doc_id", "m.*")
    return docs.join(drawn, "doc_id").select(*docs.columns, *names)
