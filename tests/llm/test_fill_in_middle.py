import hashlib
import random

import pytest
from corpora import make
from pyspark.sql import functions as F

from starwright.llm import fill_in_middle as f


def units(text, unit):
    """Where units begin, in characters."""
    if unit == "word":
        space = " \t\n\v\f\r"
        return [k for k in range(len(text)) if k == 0 or text[k] not in space and text[k - 1] in space]
    return [k for k in range(len(text)) if unit == "code_point" or k == 0 or text[k - 1] == "\n"]


def brute(doc_id, text, how):
    text = text or ""
    begins = [*units(text, how.unit), len(text)]
    n = len(begins) - 1
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in how.marks) or h[2] % 100 >= how.transformed:
        return doc_id, n, "plain", None, None, text
    a, b = (begins[u] for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = how.marks
    if h[3] % 100 < how.spm:
        return doc_id, n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return doc_id, n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def some_texts(documents):
    rng = random.Random(2)
    parts = ["a", "é", "한", "🙂", " ", "\n", "  \t", "word", "<", "<P", "S>", "é", "\r\n"]
    return [*documents, (None, ""), (600, "x<S>y"), (601, "<P>"), (602, "<M"), (603, "🙂" * 9000), (604, "\n" * 5000),
            (605, " lead and trail "), *((1000 + i, "".join(rng.choices(parts, k=rng.randint(0, 1500)))) for i in range(120))]


@pytest.mark.parametrize("how", [f.Infill(), f.Infill(7, "word"), f.Infill(3, "line", "[p]", "{s}", "(m)", 100, 50),
                                 f.Infill(2, transformed=0)])
def test_matches_brute_force(spark, documents, how):
    rows = some_texts(documents)
    for extra in (False, True):
        out = f.transform(make(spark, rows, extra), how).withColumn("back", f.restored(F.col("output"), F.col("form"), how))
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert got == sorted(((*brute(i, t, how), t or "") for i, t in rows), key=str)
    forms = {r[2] for r in got}
    assert forms == ({"plain"} if how.transformed == 0 else {"plain", "psm", "spm"})


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
def test_every_cut_of_the_tree(unit):
    """All units of texts over many blocks, whatever their number."""
    rng = random.Random(4)
    for n in (1, 3, f.BLOCK - 1, f.BLOCK, f.BLOCK + 1, 9 * f.BLOCK + 5, 16 * f.BLOCK):
        text = "".join(rng.choices(["a", "é", "🙂", " ", "\n"], k=n))
        tree = f.BlockTree(text.encode(), unit)
        begins = units(text, unit)
        assert (tree.n, tree.n_chars) == (len(begins), len(text))
        offset = [len(text[:k].encode()) for k in range(len(text) + 1)] if n < 3000 else None
        for u in range(0, len(begins) + 1, 1 if n < 3000 else 97):
            at = begins[u] if u < len(begins) else len(text)
            assert tree.cut(u) == (offset[at] if offset else len(text[:at].encode()), at)


def test_blocks_are_counted_in_parts(monkeypatch):
    text = ("one two\nthree 🙂 " * 5000).encode()
    whole = f.BlockTree(text, "word")
    monkeypatch.setattr(f, "COUNTED", 3)
    parts = f.BlockTree(text, "word")
    assert (parts.tree == whole.tree).all() and parts.cut(7777) == whole.cut(7777)


def test_marks_that_cannot_be_told_apart():
    for bad in (("<", "<", "<m"), ("<P>", "<S>", "<M<"), ("", "b", "c"), ("P", "S", "PS")):
        with pytest.raises(ValueError):
            f.Infill(1, "code_point", *bad)
    with pytest.raises(ValueError):
        f.Infill(unit="syllable")


def test_empty_table(spark):
    out = f.transform(make(spark, []))
    assert out.collect() == [] and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
