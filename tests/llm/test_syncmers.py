"""op4: an edited text shares the anchors of what it shares with the text."""

import random

from pyspark.sql import functions as F

from sphaera.llm import syncmers


def _texts(n=200):
    rng = random.Random(4)
    return ["".join(rng.choice("abé𝒳 ") for _ in range(rng.choice((0, 1, 3, 8, 11, 12, 13, 14, 15, 16, 20, 40, 100)))) for _ in range(n)]


def test_anchors_of_an_edited_text_are_those_of_the_whole(spark):
    rows = spark.createDataFrame(list(zip(_texts(), reversed(_texts()))), "text string, next string")
    for k, s in ((12, 8), (4, 2), (3, 2), (6, 3)):
        n = F.length("text")
        cut = F.floor(n / 4).cast("int")
        found = rows.withColumn("same", n - cut).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut)))
        found = found.withColumn("hashes", syncmers._anchor_hashes(F.col("text"), k, s))
        found = found.select(syncmers._edited_hashes(F.col("hashes"), F.col("edited"), F.col("same"), k, s).alias("got"), syncmers._anchor_hashes(F.col("edited"), k, s).alias("want")).collect()
        assert [r["got"] for r in found] == [r["want"] for r in found]


def test_only_the_edit_is_looked_at_again(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(20))), "doc_id long, text string")
    plan = syncmers.edited_fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(substring(edited" in plan and "split(edited" not in plan and plan.count("split(text") == 1
