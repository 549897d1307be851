"""Frames over lines: context, nearby marks, fenced and commented state, and a cache's age and size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(files: DataFrame) -> DataFrame:
    """``file, line, text`` of ``files(file, content)``, lines from 1."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def _split(files: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return files.select(*keep, "file", F.split("content", "\n").alias("all_lines"))


def _slice(values: Column, at: Column, around: int) -> Column:
    """The values from ``around`` before the place ``at`` (from 0) to as many after it."""
    return F.slice(values, F.greatest(at - around, F.lit(0)) + 1, F.least(at, F.lit(around)) + around + 1)


def lines_with_context(files: DataFrame, around: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``file, line, text, context`` of ``files(file, content)``: each line, and the lines around it joined by newlines.

    A file's lines are an array of its row, so nothing is shuffled.
    """
    each = F.transform("all_lines", lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), F.array_join(_slice(F.col("all_lines"), i, around), "\n").alias("context")))
    return _split(files, keep).select(*keep, "file", F.explode(each).alias("x")).select(*keep, "file", "x.*")


def lines_near(files: DataFrame, flag: Callable[[Column, Column], Column], around: int = 30, keep: tuple[str, ...] = ()) -> DataFrame:
    """``file, line, text`` of the lines of ``files`` at most ``around`` away from one where ``flag(text, line)`` holds; nothing is shuffled."""
    rows = _split(files, keep).withColumn("flags", F.transform("all_lines", lambda t, i: F.coalesce(flag(t, i + 1), F.lit(False))))
    rows = rows.filter(F.exists("flags", lambda x: x))
    each = F.transform("all_lines", lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), F.exists(_slice(F.col("flags"), i, around), lambda x: x).alias("near")))
    return rows.select(*keep, "file", F.explode(F.filter(each, lambda x: x.near)).alias("x")).select(*keep, "file", "x.line", "x.text")


def context(rows: DataFrame, around: int = 3) -> DataFrame:
    """``rows(file, line, text)`` with the text of the lines around each, joined by newlines."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(-around, around)
    return rows.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


def near(rows: DataFrame, flag: Column, around: int = 30) -> DataFrame:
    """``rows`` with ``near``: whether ``flag`` holds on a line at most ``around`` away."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(-around, around)
    return rows.withColumn("flag", flag).withColumn("near", F.max("flag").over(w)).drop("flag")


def fenced(rows: DataFrame) -> DataFrame:
    """``rows`` with ``in_fence`` (between lines that start with three backticks) and ``in_comment`` (HTML comments over lines)."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.ltrim("text").startswith("```")
    opened, closed = F.col("text").rlike(r"<!--(?!.*-->)"), F.col("text").contains("-->")
    out = rows.withColumn("in_fence", fence | (F.sum(fence.cast("int")).over(w) % 2 == 1))
    state = F.last(F.when(opened, 1).when(closed, 0), ignorenulls=True).over(w)
    return out.withColumn("in_comment", (F.coalesce(state, F.lit(0)) == 1) | opened | closed)


def placeholders(rows: DataFrame, marks: tuple[str, ...] = ("_(placeholder)_",)) -> DataFrame:
    """Lines outside fences and comments that hold a mark, inline code aside; drafts have none."""
    status = rows.filter(F.col("text").rlike(r"(?i)^\W*status\W*:")).groupBy("file").agg(F.lower(F.min_by("text", "line")).alias("status"))
    bare = F.regexp_replace("text", "`[^`]*`", "")
    hit = F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: bare.contains(m))
    found = fenced(rows).filter(~F.col("in_fence") & ~F.col("in_comment")).withColumn("marks", hit).filter(F.size("marks") > 0)
    return found.join(status, "file", "left").filter(~F.coalesce(F.col("status").contains("draft"), F.lit(False))).select("file", "line", F.array_join("marks", ",").alias("marks"))


def cache_kept(entries: DataFrame, now: Column, hours: int = 24, most: int = 1000) -> DataFrame:
    """Entries ``(key, created_at)`` younger than ``hours``, the newest ``most``: a cache's own limit."""
    young = entries.filter(F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
    return young.orderBy(F.col("created_at").desc(), "key").limit(most)


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Upserts as the last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")
