"""Mixing of rows that repeat id and text, or have none."""

from pyspark.sql import functions as F

from plumbline.llm import mixing


def test_repeated_rows_spread_over_blocks(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("a").alias("source"))
    rows = rows.unionByName(spark.range(40).select("id", F.concat(F.lit("text "), F.col("id")), F.lit("b")).toDF("doc_id", "text", "source"))
    got = mixing.mix(rows, block_tokens=100, max_repeats=1.0).where("source = 'a'")
    blocks = [r[0] for r in got.groupBy("block").count().select("count").collect()]
    assert sum(blocks) == 5000 and len(blocks) > 190 and max(blocks) < 60
    starts = sorted(r[0] for r in got.select("start").collect())
    assert starts == list(range(0, 20_000, 4))  # each row has its own place in the stream
    blank = rows.withColumn("text", F.lit(""))
    assert mixing.mix(blank.where("source = 'a'"), block_rows=50).select("block").distinct().count() > 90
    assert mixing.mixed_documents(rows, block_tokens=100, max_repeats=1.0).count() == rows.count()
