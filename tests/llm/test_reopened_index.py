"""A digest index that other sessions reopen."""

import pytest
from pyspark.sql import functions as F

from keyloom.llm import dedup
from keyloom.llm.common import shared_path


def test_reopened_index(spark):
    path, before = shared_path(spark, "reopened"), spark.conf.get("spark.sql.shuffle.partitions")
    table = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        index = dedup.DigestIndex(spark, path)
        assert index.deduplicate(table).filter("kept").count() == 1000
        for parts in ("8", "32"):
            spark.sql(f"DROP TABLE {index.table}")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            again = dedup.DigestIndex(spark, path)
            assert again.buckets == 16 and again.deduplicate(table).filter("kept").count() == 0 and again.read().count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        dedup.DigestIndex(spark, path, 8)
