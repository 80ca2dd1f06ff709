import hashlib
import re
from collections import defaultdict

from corpora import make

from starwright.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        if i is not None:
            groups[norm(t)].append(i)
    return {(i, hashlib.sha256(k.encode()).hexdigest()): (min(v), len(v), i == min(v)) for k, v in groups.items() for i in v}


def test_marks_every_document(spark, documents):
    rows = documents + [(900, "a\t\n b"), (901, "a b"), (902, "a b "), (903, " a b"), (901, "a b")]
    got = exact_dedup.mark_copies(make(spark, rows, extra=True)).collect()
    assert {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in got} == expected(rows)
    assert len(got) == len(expected(rows))


def test_only_survivors_are_hashed(spark):
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, "longer"), (5, "x" * 300 + "a"), (6, "x" * 300 + "b")]
    got = {r["doc_id"] for r in exact_dedup.copy_groups(make(spark, rows)).collect()}
    assert got == {1, 3}


def test_drops_copies_and_keeps_columns(spark, documents):
    docs = make(spark, documents, extra=True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({i for (i, _), v in expected(documents).items() if v[2]})
    assert kept.where("doc_id is null").count() == 1  # takes no part


def test_empty_table(spark):
    docs = make(spark, [])
    assert exact_dedup.mark_copies(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0
