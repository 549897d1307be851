"""Shared helpers: the shared folder, written intermediate tables, checks of size."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tables of at most this many narrow rows (ids, hashes, counts; under 200 bytes
#: each) may be broadcast. Anything larger is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Keys of at least this many rows, and of the rows over ``MOST_HOT``, are hot;
#: so there are at most ``MOST_HOT``, whose rows are joined where they are.
HOT_ROWS, MOST_HOT = 200, 10_000

#: Where the tables lie that ``written`` has made.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only a local-mode session that
    leaves it unset (tests, the bench) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and keeps the rows when executors are lost.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once no plan reads them any more; others are left alone."""
    for table in tables:
        if path := _FOLDERS.pop(table, None):
            delete(table.sparkSession, path)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it until no column of ``taken`` has it, whatever the case."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null.

    ``lower`` is much faster and equal to it on texts of ASCII only.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``right`` if it is small by count, else let it be shuffled."""
    return left.join(F.broadcast(right) if small_enough(right, limit) else right, on, how)


def join_uneven(rows: DataFrame, table: DataFrame, on: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table``, which has one row for each key and in ``n`` how many of the rows have it.

    ``total`` is the number of rows, for left joins at most that of those with a
    key in ``table``. Rows of hot keys stay where they are and get the key's row
    by broadcast; there are at most ``MOST_HOT`` such keys. Only the others are
    dealt by their key. ``n`` isn't kept; null keys match nothing.
    """
    on = [on] if isinstance(on, str) else on
    values = [c for c in table.columns if c not in (*on, "n")]
    hot = table.filter(F.col("n") >= max(HOT_ROWS, total // MOST_HOT)).select(*on, F.struct(F.lit(1).alias("hot"), *values).alias("hot"))
    marked = rows.join(F.broadcast(hot), on, "left").select(*rows.columns, "hot")
    apart = marked.filter("hot is not null").select(*rows.columns, *[F.col("hot")[v].alias(v) for v in values])
    rest = marked.filter("hot is null").select(*rows.columns).join(table.select(*on, *values), on, how)
    return apart.unionByName(rest.select(*rows.columns, *values))
