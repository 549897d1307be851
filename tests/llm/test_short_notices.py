"""Short licence notices are all found."""

from pyspark.sql import functions as F

from keyloom.llm import licenses


def test_short_notices(spark):
    noise = lambda a: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit(a), F.col("id").cast("string"), F.lit("x"), k.cast("string"))), " ")
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", noise("a"), F.lit("Released under the MIT License."), noise("b")).alias("text"))
    assert licenses.scan_licenses(table).filter("licenses <> 'MIT'").count() == 0
    for m, of in licenses.groups().items():
        assert all((1 - licenses.similarity(m, text)) ** licenses.bands_of()[m] <= 1e-6 for _, _, text in of)
