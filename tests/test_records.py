"""Quoted line breaks read in splits: the records, numbers and raw text of
random files, against the multi-line parser and against a plain scan."""

import os
import random

import pytest
from pyspark.sql import types as T

from starwright.sources import records
from starwright.sources.csv_load import load_csv, load_table, preview, preview_raw, profile, read_numbered_fields, read_text_fields

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


@pytest.fixture()
def tiny_splits(spark):
    """Splits of a few dozen bytes: every file spans many."""
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def field(rng, spaces, stray):
    kind = rng.random()
    if kind < 0.4:
        body = "".join(rng.choices(["a", "b", " ", ",", "\n", '""', "é", "\n\n"], k=rng.randint(0, 12)))
        return rng.choice(["", " "] if spaces else [""]) + f'"{body}"' + rng.choice(["", " "])
    if kind < 0.5:
        return ""
    if stray and kind < 0.6:
        return rng.choice(['a"b', '5"', 'a "b" c', 'a""b'])
    return "".join(rng.choices(["a", "b", " ", "1", "é"], k=rng.randint(1, 8)))


def random_files(rng, folder, spaces, stray):
    os.makedirs(folder)
    for k in range(2):
        rows = ["h1,h2,h3"] + [",".join(field(rng, spaces, stray) for _ in range(rng.randint(1, 4)))
                               for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.4:
            rows.insert(rng.randint(0, len(rows)), "")
        text = "\n".join(rows) + rng.choice(["\n", ""])
        with open(f"{folder}/{k}.csv", "w", newline="", encoding="utf-8") as f:
            f.write(text.replace("\n", rng.choice(["\n", "\r\n"])))


@pytest.mark.parametrize("seed", range(8))
def test_equals_the_multi_line_parser(spark, tmp_dir, tiny_splits, seed):
    rng = random.Random(seed)
    trim = seed % 2 == 0
    random_files(rng, f"{tmp_dir}/in", trim, seed % 4 > 1)
    fmt = profile("flex").with_options(trim_space=trim)
    plain = lambda rows: sorted(tuple(v or "" for v in r) for r in rows)
    want = read_text_fields(spark, f"{tmp_dir}/in", list("abc"), fmt).select(*"abc").collect()
    got = read_numbered_fields(spark, f"{tmp_dir}/in", list("abc"), fmt)
    assert plain(got.select(*"abc").collect()) == plain(want)
    rows, rejects = load_csv(spark, f"{tmp_dir}/in", TEXT, fmt, numbered=True)
    assert plain(rows.collect()) == plain(load_csv(spark, f"{tmp_dir}/in", TEXT, fmt).rows.collect())
    assert rejects.count() == 0


def test_numbers_and_raw_records(spark, tmp_dir, tiny_splits):
    """Line numbers and raw text against a plain scan of the file."""
    rng = random.Random(9)
    random_files(rng, f"{tmp_dir}/in", False, False)
    got = sorted(tuple(r) for r in records.read_records(spark, f"{tmp_dir}/in", skip_space=False).collect())
    want = []
    for name in ("0.csv", "1.csv"):
        with open(f"{tmp_dir}/in/{name}", newline="", encoding="utf-8") as f:
            lines = f.read().replace("\r\n", "\n").split("\n")
        at, first = 0, True
        while at < len(lines):
            end = at + 1
            while "\n".join(lines[at:end]).count('"') % 2:
                end += 1
            raw = "\n".join(lines[at:end])
            if raw and not first:
                want.append((f"file:{tmp_dir}/in/{name}", at + 1, raw))
            first &= not raw
            at = end
    assert got == sorted(want) and any("\n" in raw for *_, raw in want)


def test_rejects_carry_line_and_record(spark, tmp_dir, tiny_splits):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "w") as f:
        f.write('id,note\n1,"two\nlines"\n\nx,"bad\n\nid"\n3,' + "long " * 60 + "\ny,last")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType())])
    rows, rejects = load_csv(spark, f"{tmp_dir}/in", schema, numbered=True)
    assert sorted(r["id"] for r in rows.collect()) == [1, 3]
    assert sorted((os.path.basename(r["file_path"]), r["line_number"], r["raw_record"], r["column_name"], r["raw_value"])
                  for r in rejects.collect()) == [
        ("a.csv", 5, 'x,"bad\n\nid"', "id", "x"), ("a.csv", 9, "y,last", "id", "y")]
    report = load_table(spark, f"{tmp_dir}/in", schema, f"{tmp_dir}/t", f"{tmp_dir}/r", numbered=True, table_name="t").first()
    assert tuple(report) == ("t", 4, 2, 2, True)
    assert spark.read.parquet(f"{tmp_dir}/r").where("line_number = 5").count() == 1
    by_name, _ = load_csv(spark, f"{tmp_dir}/in", T.StructType(schema.fields[::-1]), numbered=True, by_name=True)
    assert sorted((r["id"], r["note"][:3]) for r in by_name.collect()) == [(1, "two"), (3, "lon")]
    with pytest.raises(ValueError):
        load_csv(spark, f"{tmp_dir}/in", schema, profile("utf8").with_options(encoding="ISO-8859-1"), numbered=True)


def test_escaped_quotes_and_other_delimiters(spark, tmp_dir, tiny_splits):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "w") as f:
        f.write('a|b|c\n"x\\"\ny"|"|"|1\n"e\\\\"|"\\",\n"|2\n|"\n\n"|3\n')
    fmt = profile("repaired").with_options(doubled_quotes=False, delimiter="|")
    plain = lambda rows: sorted(tuple(v or "" for v in r) for r in rows)
    want = read_text_fields(spark, f"{tmp_dir}/in", list("abc"), fmt).select(*"abc").collect()
    got = read_numbered_fields(spark, f"{tmp_dir}/in", list("abc"), fmt).select(*"abc").collect()
    assert len(got) == 3 and plain(got) == plain(want)


def test_long_lines_and_quotes_that_stay_open(spark, tmp_dir, tiny_splits):
    """Patterns neither recurse nor backtrack; an open quote takes what follows."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "w") as f:
        f.write("a,b,c\n" + '"' + '""' * 100_000 + 'x""\n"",' + '"",' * 50_000 + '"\n')
        f.write(",".join(['"q"'] * 60_000) + "\n1,2,3\n")
    with open(f"{tmp_dir}/in/b.csv", "w") as f:
        f.write('a,b,c\n1,"open,\n2,x\n\n3,y\n')
    got = {(os.path.basename(r[0]), r[1]): r[2] for r in records.read_records(spark, f"{tmp_dir}/in").collect()}
    assert sorted(got) == [("a.csv", 2), ("a.csv", 4), ("a.csv", 5), ("b.csv", 2)]
    assert got["a.csv", 5] == "1,2,3" and got["b.csv", 2] == '1,"open,\n2,x\n\n3,y'
    assert got["a.csv", 2].count('"') == 300_006 and got["a.csv", 2].count("\n") == 1


def test_empty_files_and_headers_only(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    open(f"{tmp_dir}/in/none.csv", "w").close()
    with open(f"{tmp_dir}/in/head.csv", "w") as f:
        f.write("\r\n\r\na,b,c\r\n")
    assert records.read_records(spark, f"{tmp_dir}/in").count() == 0
    assert [tuple(r)[1:] for r in records.read_records(spark, f"{tmp_dir}/in", header=False).collect()] == [(3, "a,b,c")]
    assert records.read_records(spark, f"{tmp_dir}/in", quote=None).count() == 0


def test_previews_of_long_lines(spark, tmp_dir, tiny_splits):
    """Files whose first split holds too few lines still show all asked for."""
    os.makedirs(f"{tmp_dir}/in")
    for name, width in (("short", 1), ("long", 300)):
        with open(f"{tmp_dir}/in/{name}.csv", "w") as f:
            f.write("h1,h2\n" + "".join(f"{k},{'x' * width}\n" for k in range(9)))
    got = preview(spark, f"{tmp_dir}/in", n=5).select("file_name", "line_number", "col1").collect()
    assert [tuple(r) for r in got] == [(f"{f}.csv", k + 1, str(k)) for f in ("long", "short") for k in range(5)]
    raw = preview_raw(spark, f"{tmp_dir}/in", n=20).collect()
    assert [(r["file_name"], r["line_number"], len(r["value"])) for r in raw] == [
        (f"{f}.csv", k + 1, 2 + w) for f, w in (("long", 300), ("short", 1)) for k in range(9)]
