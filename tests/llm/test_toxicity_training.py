import numpy as np
from pyspark.sql import functions as F

from starwright.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_scores_do_not_depend_on_the_sample_bounds(spark, monkeypatch):
    """Fewer ordinary documents in the sample leave the scores about the same:
    on average they are the corpus's toxic share, not the sample's."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    share = labels.agg(F.avg("toxic")).first()[0]
    known = docs.join(labels, "doc_id").select("doc_id", "text")
    means = []
    for bounds in ((2000, 5000), (2000, 900), (300, 900)):
        monkeypatch.setattr(toxicity, "MAX_TOXIC", bounds[0])
        monkeypatch.setattr(toxicity, "MAX_ORDINARY", bounds[1])
        model = toxicity.fit(docs, labels, F.lit(True))
        assert abs(model.share - share) < 1e-9
        means.append(toxicity.score(known, model).agg(F.avg("score")).first()[0])
    assert np.abs(np.array(means) - share).max() < 0.03


def test_ordinary_text_comes_from_the_whole_sample():
    """Neither the first texts only nor their beginnings only."""
    texts = [" ".join(f"{i}x{k}x" for k in range(300)) for i in range(1000)]
    model = toxicity.train([(t, 0) for t in texts] + [(f"{t[:50]} zymurgy", 1) for t in texts[:90]])
    words = [w.split(b"x") for w in model.ordinary.split() if w.count(b"x") == 2 and w.endswith(b"x")]
    own, place = np.array([(int(i), int(k)) for i, k, _ in words if i.isdigit() and k.isdigit()]).T
    assert len(set(own)) > 100 and 400 < np.median(own) < 600
    assert place.max() > 290 and place.min() < 10 and 100 < np.median(place) < 200
    assert toxicity.ordinary_text(texts) == toxicity.ordinary_text(texts[::-1])


def test_every_part_of_a_text_without_white_space_is_compared():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(300)]
    clean = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    toxic = [" ".join([*rng.choice(words, 50), "zymurgy", "quixotic"]) for _ in range(40)]
    distance = toxicity.Distance(toxicity.train([(t, 1) for t in toxic] + [(t, 0) for t in clean]))
    han = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 200_000)))  # 600,000 bytes
    marked = han[:195_000] + "zymurgyquixotic" + han[195_000:]
    assert distance.features(marked)[0] > distance.features(han)[0]
    assert max(map(len, toxicity._windows(marked))) <= toxicity.WINDOW_BYTES + len(toxicity._MARK)
    # No string is lost at a cut, and texts of short windows stay as they were.
    data, shared = (" " + marked).encode(), max(toxicity.STRING_LENGTHS)
    parts = [w[len(toxicity._MARK):] for w in toxicity._windows(marked)]
    assert parts[0] + b"".join(p[shared:] for p in parts[1:]) == data
    assert toxicity._windows("a b") == [toxicity._MARK + b" a b"]
