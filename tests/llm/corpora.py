"""Small document tables for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=False):
    """Documents from (doc_id, text) pairs; ``extra`` adds columns named like
    the operators' own ones."""
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    if extra:
        for name in ("text_sha256", "text_key", "spans", "own_id", "copy", "n", "score", "token", "bucket", "ahead",
                     "set_key", "component_id", "rank", "part", "length", "label"):
            docs = docs.selectExpr("*", f"cast(7 as int) as {name}")
    return docs.repartition(3)
