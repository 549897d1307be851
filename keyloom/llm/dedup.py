"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest, at a path that all
executors share. A batch is deduplicated by a sort-merge anti-join against it,
which moves the batch's digests to the index's buckets and leaves the index
where it lies; the digests that are new are appended. Native operations only.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, delete, join_checked, shared_path, text_or_empty, written

#: Digests of at least this many rows of a batch, and of the batch's rows over
#: ``MOST_HOT``, are hot; so there are at most ``MOST_HOT``, which are broadcast.
HOT_ROWS, MOST_HOT = 1_000, 100_000


class DigestIndex:
    """A persistent index of text digests: ``digest, keep_id, group_size, batch``.

    ``path`` outlives the session: opening it again registers the same files.
    ``buckets`` is fixed when the index is first made, and stored in
    ``{path}-buckets``: other sessions take the stored number, and fail if they
    ask for another. Take about one for each 256 MB that the index is to hold.
    An append writes one file for each bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stored(buckets)
        self.table = "keyloom_digests_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

        declared = [int(r.data_type) for r in spark.sql(f"DESCRIBE EXTENDED {self.table}").collect() if r.col_name == "Num Buckets"]
        if declared != [self.buckets]:
            raise ValueError(f"{self.table} is declared with {declared} buckets, its files have {self.buckets}")

    def _stored(self, asked: int | None) -> int:
        """The bucket count of the index's files; stored here if the index is new."""
        at = f"{self.path}-buckets"
        try:
            stored = self.spark.read.schema("buckets int").parquet(at).collect()[0].buckets
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            if asked is None and self._has_files():
                raise ValueError(f"{at} is missing: give the bucket count with which {self.path} was made") from e
            stored = asked or max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            self.spark.range(1).select(F.lit(stored).cast("int").alias("buckets")).write.parquet(at)
        if asked not in (None, stored):
            raise ValueError(f"{self.path} has {stored} buckets, not {asked}")
        return stored

    def _has_files(self) -> bool:
        try:
            return not self.spark.read.schema("digest binary").parquet(self.path).isEmpty()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def add(self, groups: DataFrame, batch: str | None = None) -> str:
        """Append the digests of ``groups(digest, keep_id, group_size)`` that the index lacks; returns the batch's name.

        A batch that is added again under its name appends what it lacks of it, that is nothing if it was whole.
        """
        batch = batch or uuid.uuid4().hex
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        new = new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").sortWithinPartitions("digest")
        new.select("digest", "keep_id", "group_size", "batch").write.insertInto(self.table)
        return batch

    def drop(self) -> None:
        """Forget the index and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)
        delete(self.spark, f"{self.path}-buckets")

    def deduplicate(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Append ``docs(doc_id, text)`` and return what became of every row.

        A job that may be run again, say after the driver was lost, must name
        its ``batch``: then a second run finds its own digests and gives the
        same result. Without a name each call is a batch of its own.

        Columns: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal
        when identical after lower-casing A-Z only; null counts as empty. Of
        equal texts of a batch the row with the largest doc_id stays; texts that
        the index had before all go, with the keep_id of the batch that brought
        them. group_size is that of the batch that brought the text. Rows that
        repeat a doc_id are one document and share its fate; a row without a
        doc_id can't be named and stays. An empty table gives no rows and leaves
        the index as it is. Other columns are not read.
        """
        digests = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(text_or_empty()), 256)).alias("digest")), "digests")
        # copies are counted before they are moved: a group of any size is one row per task
        groups = written(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
        batch = self.add(groups, batch)
        # rows of hot groups stay where they are and get the group's row; the others go to the index's buckets
        hot = groups.filter(F.col("group_size") >= max(HOT_ROWS, digests.count() // MOST_HOT)).select("digest").join(self.read(), "digest")
        hot = written(hot.select("digest", F.struct("keep_id", "group_size", "batch").alias("hot")), "hot")
        marked = digests.join(F.broadcast(hot), "digest", "left")
        apart = marked.filter("hot is not null").select("doc_id", "digest", "hot.*")
        rest = marked.filter("hot is null").select("doc_id", "digest").join(self.read().hint("merge"), "digest").select("doc_id", "digest", "keep_id", "group_size", "batch")
        rows = apart.unionByName(rest)
        kept = F.col("doc_id").isNull() | ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a fresh index, deleted afterwards, unless one is given.

    A doc_id that is repeated with several texts stays, all its rows, if one of them does: no text is lost.
    """
    own = index or DigestIndex(docs.sparkSession, shared_path(docs.sparkSession, "digest-index"))
    gone = written(own.deduplicate(docs, batch).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id"), "gone")
    if index is None:
        own.drop()
    return join_checked(docs, gone, "doc_id", "left_anti")
