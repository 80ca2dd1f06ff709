import corpus_pipeline
from pyspark.sql import functions as F

from starwright.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_pipeline_drops_what_the_operator_predicts_toxic(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).toPandas()
    assert scores.score.between(0.3, 0.5).sum() > 10
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    assert kept == set(scores.doc_id[scores.score < toxicity.THRESHOLD])
