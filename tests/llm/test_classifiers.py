import numpy as np
import pytest
from corpora import make
from pyspark.sql import functions as F

from starwright.llm import labels, quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    _, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.bincount(inverse, rank) / n)[inverse]
    return (rank[label == 1].mean() - rank[label == 0].mean()) / len(score) + 0.5


@pytest.mark.parametrize("query,label,modulus,least,accuracy", [
    ("op4_toxicity", "toxic", 4, 0.85, 0.93), ("op10_quality", "quality", 5, 0.99, 0.97)])
def test_held_out_documents(spark, query, label, modulus, least, accuracy):
    from starwright.llm.queries import QUERIES

    out = QUERIES[query](spark, SF)
    known = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(known, "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert auc(rows.score.values, rows[label].values) > least
    assert (rows.predicted == rows[label]).mean() > accuracy
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_remainder(spark):
    import zlib

    rows = spark.range(50).select("id", labels.remainder("id", 4).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)


def test_strings_and_distance():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(300)]
    clean = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    toxic = [" ".join([*rng.choice(words, 50), "zymurgy", "quixotic"]) for _ in range(40)]
    marks = toxicity.toxic_strings(toxic, clean)
    assert any(b"zymurgy" in m for m in marks) and any(b"quixotic" in m for m in marks) and len(marks) < 6
    model = toxicity.train([(t, 1) for t in toxic] + [(t, 0) for t in clean])
    distance = toxicity.Distance(model)
    assert distance.features(toxic[0])[1] > distance.features(clean[0])[1]
    assert distance.features(None) == distance.features("  ") == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("size", [5_000, 20_000, 48_000])
def test_strings_are_found_in_dictionaries_of_any_size(size):
    rng = np.random.default_rng(0)
    words = [" " + "".join(rng.choice(list("abcdefg"), 5)) for _ in range(300)]
    base = "".join(rng.choice(words, size // 6)).encode()
    marks = [b" zymurgy", b" quixotic", b" foobarx", b" lastone"]
    filler = b"\xff" * sum(map(len, marks))
    distance = toxicity.Distance(toxicity.Model(base + filler + toxicity._MARK, base + b"".join(marks) + toxicity._MARK))
    for mark in marks:
        assert distance.features(f"abcde fgabc{mark.decode()} gfedc")[1] >= toxicity.LEAST_SAVED


def test_drop_toxic_keeps_columns(spark, documents):
    docs = make(spark, documents, extra=True)
    model = toxicity.Model(share=0.1)
    out = toxicity.drop_toxic(docs, model)
    assert out.columns == docs.columns and out.count() == len(documents)
    assert toxicity.drop_toxic(docs, toxicity.Model(share=0.9)).count() == 0


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_too_few_labels(spark, documents, module, label):
    docs = make(spark, documents, extra=True)
    for known in ([], [(1, 1, 1), (1, 0, 0), (None, 0, 0), (2, 1, 1)], [(1, None, None)]):
        table = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
        scores = module.score(docs, module.fit(docs, table, F.lit(True))).collect()
        assert len(scores) == len(documents) and len({r["score"] for r in scores}) == 1
        assert all(0 <= r["score"] <= 1 for r in scores)
    empty = make(spark, [])
    table = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score(empty, module.fit(empty, table, F.lit(True))).count() == 0


def test_equal_texts_have_equal_scores(spark, documents):
    rng = np.random.default_rng(0)
    known = [(i, int(rng.random() < 0.5), int(rng.random() < 0.5)) for i, _ in documents if i is not None]
    table = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    docs = make(spark, documents)
    for module in (toxicity, quality):
        rows = module.score(docs, module.fit(docs, table, F.lit(True))).collect()
        assert len(rows) == len(documents)
        by_id = {r["doc_id"]: r["score"] for r in rows}
        assert len({by_id[400 + i] for i in range(9)}) == 1 and by_id[100] == by_id[101]


def test_pairwise_weights_rank():
    rng = np.random.default_rng(0)
    good = [(" ".join(f"w{x}" for x in rng.integers(0, 500, 80)) + ".", 1) for _ in range(60)]
    bad = [("SPAM!! " * int(rng.integers(10, 60)), 0) for _ in range(20)]
    model = quality.train(good + bad, 0.75, pairs=2000)
    scores = model.scores(np.array([quality.features(t) for t, _ in good + bad]))
    assert scores[:60].min() >= quality.THRESHOLD > scores[60:].max()


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_null_ids_and_null_texts(spark, documents, module, label):
    """Null ids are scored and kept, and teach nothing, as labels of null texts do not."""
    rng = np.random.default_rng(0)
    known = [(i, int(rng.random() < 0.5), int(rng.random() < 0.5)) for i, _ in documents if i is not None]
    schema = "doc_id long, quality int, toxic int"
    model = module.fit(make(spark, documents), spark.createDataFrame(known, schema), F.lit(True))
    more = make(spark, [*documents, (None, "null id"), (990_001, None), (990_002, "")])
    other = module.fit(more, spark.createDataFrame([*known, (None, 1, 1), (990_001, 1, 1), (990_001, 0, 0)], schema), F.lit(True))
    # The labels are counted in the classes' share; the texts teach the same.
    if module is toxicity:
        assert (other.ordinary, other.toxic) == (model.ordinary, model.toxic)
    assert abs(other.share - model.share) < 0.1
    out = module.score(more, model).select("doc_id", "score", (labels.remainder("doc_id", 4) == 2).alias("held_out")).collect()
    assert len(out) == len(documents) + 3 and all(0 <= r["score"] <= 1 for r in out)
    assert all((r["held_out"] is None) == (r["doc_id"] is None) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (990_001, 990_002)}) == 1


def test_quality_of_a_very_long_text(spark):
    """The whole text counts, not its beginning, in bounded blocks."""
    clean = "A plain sentence about the weather in the valley. " * 60_000  # 3 MB
    spam = clean[:1_500_000] + "BUY!! 100% $$$ " * 100_000
    rows = make(spark, [(1, clean), (2, spam)])
    rng = np.random.default_rng(0)
    good = [(" ".join(f"w{x}" for x in rng.integers(0, 500, 80)) + ".", 1) for _ in range(60)]
    model = quality.train(good + [("SPAM!! $$ " * int(rng.integers(10, 60)), 0) for _ in range(20)], 0.75, pairs=2000)
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, model).collect()}
    want = model.scores(np.array([quality.features(clean), quality.features(spam)]))
    assert [got[1], got[2]] == list(want) and quality.features(spam) != quality.features(spam[:1_500_000])


def test_curve_is_fitted_on_documents_the_dictionaries_have_not_seen():
    """Words that single toxic documents have for themselves promise nothing."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(300)]
    text = lambda *own: " ".join([*rng.choice(words, 60), *own])
    noise = [(text(*[f"own{i}word{k}" for k in range(8)]), i % 4 == 0) for i in range(400)]
    model = toxicity.train([(t, int(y)) for t, y in noise])
    scores = [1 / (1 + np.exp(-(np.dot(model.weights[:-1], toxicity.Distance(model).features(text())) + model.weights[-1])))
              for _ in range(5)]
    assert abs(np.mean(scores) - 0.25) < 0.1


def _texts(n, seed):
    """Plain texts (1) and shouted ones (0), some of them with the other's label."""
    rng = np.random.default_rng(seed)
    plain = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 300, k)) + "."
    out = []
    for i in range(n):
        good, k = i % 4 != 0, int(rng.integers(20, 90))
        text = plain(k) if good else " ".join("SPAM!!" if rng.random() < 0.3 else f"w{rng.integers(0, 300)}" for _ in range(k))
        out.append((text, int(good != (i % 10 == 3))))
    return out


def test_quality_learns_from_every_labelled_document(spark):
    """Long texts teach like short ones, and the model is that of all labels."""
    sample = [(t + " " + "and so on, " * 2500 if i % 3 == 0 else t, y) for i, (t, y) in enumerate(_texts(240, 1))]
    assert sum(len(t) > 20_000 for t, _ in sample) == 80
    docs = make(spark, list(enumerate(t for t, _ in sample)))
    table = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(sample)], "doc_id long, quality int")
    got = quality.fit(docs, table, F.lit(True))
    want = quality.train(sample, float(np.mean([y for _, y in sample])))
    x = np.array([quality.features(t) for t, _ in sample])
    assert np.abs(got.scores(x) - want.scores(x)).max() < 1e-6
    measured = quality.measure(docs, table, F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in quality.score_measured(measured, got).collect()}
    assert np.abs(np.array([scores[i] for i in range(len(sample))]) - got.scores(x)).max() < 1e-9
    only_long = docs.where(F.length("text") > 20_000)
    assert quality.fit(only_long, table, F.lit(True)).weights


def test_quality_weights_are_those_of_all_pairs():
    sample = _texts(200, 2)
    x, y = np.array([quality.features(t) for t, _ in sample]), np.array([label for _, label in sample])
    difference = (x[y == 1][:, None] - x[y == 0]).reshape(-1, x.shape[1])
    scale = np.sqrt((x[y == 1].var(0) + x[y == 0].var(0)) + (x[y == 1].mean(0) - x[y == 0].mean(0)) ** 2) + 1e-9
    z, w = difference / scale, np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method on every pair by itself
        p = 1 / (1 + np.exp(np.clip(z @ w, -30, 30)))
        grad = -(z.T @ p) / len(z) + quality.RIDGE / quality.PAIRS * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + np.eye(len(w)) * quality.RIDGE / quality.PAIRS, grad)
        w -= step * min(1.0, 4 / np.sqrt(step @ step + 1e-30))
    model = quality.train(sample, float(y.mean()))
    strength = x @ np.array(model.weights)
    assert np.corrcoef(strength, x @ (w / scale))[0, 1] > 0.999
    assert abs((strength >= model.cut).mean() - y.mean()) < 0.011  # the cut is the quantile of all strengths
