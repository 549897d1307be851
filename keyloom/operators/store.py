"""Lookups over a service's own tables: users, projects, rules, keys; encrypted columns; when repeated failures end a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tier of a user that isn't known; the classes of failures that count, and how many are too many.
DEFAULT_TIER = "free"
REGRESSION, SYNTAX, UNSOUND = "functional_regression", "syntax_invalid", "unsound_success"
MOST_REGRESSIONS, SYNTAX_RUN, MOST_UNSOUND = 2, 3, 1


def user_tiers(asked: DataFrame, users: DataFrame) -> DataFrame:
    """``asked(user_id)`` with ``tier``, that of ``users(user_id, tier)`` or the default."""
    known = users.groupBy("user_id").agg(F.min("tier").alias("tier"))
    return asked.join(known, "user_id", "left").withColumn("tier", F.coalesce("tier", F.lit(DEFAULT_TIER)))


def project_owners(asked: DataFrame, projects: DataFrame) -> DataFrame:
    """``asked(project_id)`` with ``owner``, null for projects that aren't known."""
    known = projects.groupBy("project_id").agg(F.min("user_id").alias("owner"))
    return asked.join(known, "project_id", "left")


def enabled_rules(config: DataFrame) -> DataFrame:
    """``project_id, rule_id, priority`` of the rules that are on."""
    return config.filter("enabled = 1").select("project_id", "rule_id", "priority")


def usable_keys(keys: DataFrame, now: Column, address: Column) -> DataFrame:
    """Keys ``(is_active, expires_at, allowed_ip)`` that are on, not expired, and open to ``address``; a null bound doesn't bind."""
    return keys.filter((F.col("is_active") == 1) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.col("allowed_ip").isNull() | (F.col("allowed_ip") == address)))


def encrypted(rows: DataFrame, columns: tuple[str, ...], key: Column) -> DataFrame:
    """``rows`` with ``columns`` as base64 of AES-GCM; nulls stay."""
    return rows.withColumns({c: F.base64(F.aes_encrypt(F.col(c).cast("string"), key)) for c in columns})


def decrypted(rows: DataFrame, columns: tuple[str, ...], key: Column) -> DataFrame:
    return rows.withColumns({c: F.aes_decrypt(F.unbase64(F.col(c)), key).cast("string") for c in columns})


def failure_decay(failures: DataFrame) -> DataFrame:
    """``session, should_abort, mode`` of ``failures(session, seq, failure_class)``: the first of three limits that is passed.

    Of a session's order only the last few rows count, which each task cuts to before the shuffle.
    """
    counts = failures.groupBy("session").agg(F.count_if(F.col("failure_class") == REGRESSION).alias("regressions"), F.count_if(F.col("failure_class") == UNSOUND).alias("unsound"))
    last = failures.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.col("seq").desc()))).filter(F.col("n") <= SYNTAX_RUN)
    spin = last.groupBy("session").agg((F.count_if(F.col("failure_class") == SYNTAX) == SYNTAX_RUN).alias("spin"))
    mode = F.when(F.col("regressions") > MOST_REGRESSIONS, "SAFE_MODE").when(F.col("spin") | (F.col("unsound") > MOST_UNSOUND), "STOP").otherwise("NORMAL")
    return counts.join(spin, "session").select("session", (mode != "NORMAL").alias("should_abort"), mode.alias("mode"))
