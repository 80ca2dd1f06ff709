"""Delimited-file loading: ragged rows, rejects, NULL tokens, trimming,
quoting, invalid UTF-8, header binding, previews and export round trip."""

import os

import pytest
from pyspark.sql import types as T

from starwright.sources.csv_load import PROFILES, load_csv, preview, preview_raw
from starwright.sources.sinks import export_tables

SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])


def _write(tmp_dir, name, data: bytes):
    path = os.path.join(tmp_dir, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_ragged_rows_and_rejects(spark, tmp_dir):
    p = _write(tmp_dir, "a.csv", b"id,name,ts\n"
               b"1,Ann,2006-02-15 04:57:20\n"
               b"2,Bob\n"                      # short row: padded
               b"3,Cy,2006-02-15 05:00:00,extra\n"  # long row: extra dropped
               b"x,Dee,2006-02-15 05:00:00\n"   # bad int
               b"5,Eve,zz\n")                   # bad timestamp
    rows, rejects = load_csv(spark, p, SCHEMA, "utf8")
    got = sorted((r.id, r.name, r.ts is None) for r in rows.collect())
    assert got == [(1, "Ann", False), (2, "Bob", True), (3, "Cy", False)]
    rej = sorted((r.file_name, r.column_name, r.raw_value, r.reason) for r in rejects.collect())
    assert rej == [("a.csv", "id", "x", "cannot convert to int"),
                   ("a.csv", "ts", "zz", "cannot convert to timestamp_ntz")]
    assert rows.count() + rejects.select("raw_value").count() == 5


def test_null_tokens_trim_and_quotes(spark, tmp_dir):
    p = _write(tmp_dir, "b.csv", b'id,name,ts\n'
               b'1,NULL,\n'
               b'2,null,\n'
               b'3,"",\n'
               b'4,  Ann  ,\n'
               b'5,"O\\"N",\n'
               b'6,"a,b",\n'
               b'7,N,\n')
    rows, rejects = load_csv(spark, p, SCHEMA, "repaired")
    got = {r.id: r.name for r in rows.collect()}
    assert got[1] is None and got[2] is None and got[3] is None
    assert got[4] == "Ann"
    assert got[5] == 'O"N' and got[6] == "a,b"
    assert got[7] == "N"  # a bare N is data unless asked for
    rows_n, _ = load_csv(spark, p, SCHEMA, "repaired", bare_n_is_null=True)
    assert {r.id: r.name for r in rows_n.collect()}[7] is None
    assert rejects.count() == 0


def test_invalid_utf8_is_replaced(spark, tmp_dir):
    p = _write(tmp_dir, "c.csv", b"id,name,ts\n1,ab\xff\xfecd,\n")
    rows, _ = load_csv(spark, p, SCHEMA, "final")
    name = rows.first().name
    assert "�" in name and name.startswith("ab") and name.endswith("cd")
    assert rows.selectExpr("is_valid_utf8(name) AS ok").first().ok


def test_load_by_header_name(spark, tmp_dir):
    # city file written in source order: key, country key, name, id
    p = _write(tmp_dir, "city.csv", b"city_key,country_key,city,city_id\n601,110,Rome,5\n")
    schema = T.StructType([T.StructField(n, T.IntegerType()) if n != "city" else T.StructField(n, T.StringType())
                           for n in ["city_key", "city_id", "city", "country_key"]])
    by_pos, _ = load_csv(spark, p, schema, "utf8")
    r = by_pos.first()
    assert (r.city_id, r.country_key) == (110, 5)  # by position: ids silently swapped
    by_name, rej2 = load_csv(spark, p, schema, "utf8", by_name=True)
    r = by_name.first()
    assert (r.city_key, r.city_id, r.city, r.country_key) == (601, 5, "Rome", 110)
    assert rej2.count() == 0


def test_header_only_file(spark, tmp_dir):
    p = _write(tmp_dir, "d.csv", b"id,name,ts\n")
    rows, rejects = load_csv(spark, p, SCHEMA, "flex")
    assert rows.count() == 0 and rejects.count() == 0


def test_tab_delimiter_profile(spark, tmp_dir):
    p = _write(tmp_dir, "e.tsv", b"id\tname\tts\n1\tAnn\t2006-02-15 04:57:20\n")
    rows, _ = load_csv(spark, p, SCHEMA, PROFILES["utf8"].with_options(delimiter="\t"))
    assert rows.first().name == "Ann"


def test_previews(spark, tmp_dir):
    lines = b"id,name,ts\n" + b"".join(b"%d,n%d,2006-01-01 00:00:00\n" % (i, i) for i in range(1, 16))
    p = _write(tmp_dir, "f.csv", lines)
    pv = preview(spark, p, "flex", n=10).collect()
    assert [r.line_number for r in pv] == list(range(1, 11))
    assert (pv[0].col1, pv[0].col2, pv[9].col1) == ("1", "n1", "10")
    assert pv[0].file_name == "f.csv"
    raw = [r.value for r in preview_raw(spark, p, 3).collect()]
    assert raw == [f"{i},n{i},2006-01-01 00:00:00" for i in (1, 2, 3)]  # header skipped, no tab: whole lines
    tabs = _write(tmp_dir, "t.tsv", b"h1\th2\na\tb\nc\td\n")
    assert [r.value for r in preview_raw(spark, tabs, 1).collect()] == ["a"]
    assert [r.value for r in preview_raw(spark, tabs, 3, skip_header=False).collect()] == ["h1", "a", "c"]


def test_export_load_round_trip(spark, tmp_dir):
    import datetime as dt
    df = spark.createDataFrame([(1, 'O"N, a', dt.datetime(2006, 2, 15, 4, 57, 20)), (2, None, None)], SCHEMA)
    paths = export_tables({"t": df}, tmp_dir)
    rows, rejects = load_csv(spark, paths["t"], SCHEMA)
    assert rejects.count() == 0
    assert sorted(rows.collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)


def test_guards_never_change_a_conversion(spark):
    """The fast-path patterns only skip text the conversion rejects anyway."""
    from pyspark.sql import functions as F
    from starwright.sources.csv_load import _convert, _typed
    samples = ["1", " 42 ", "+7", "-0", "1.0", "1.5", ".5", "5-LOW", "x", "", " ", "2147483648", "  12",
               "1e5", "Infinity", "-inf", "NaN", "0x1p3", "1.5d", "yes", "N", " TRUE ", "no", "2006-02-15 04:57:20",
               "2006-02-15", "zz", "12:00"]
    df = spark.createDataFrame([(v,) for v in samples], "raw string")
    fmt = PROFILES["format"]
    for dtype in [T.IntegerType(), T.LongType(), T.ShortType(), T.DoubleType(), T.FloatType(), T.DecimalType(10, 2),
                  T.BooleanType(), T.DateType(), T.TimestampNTZType()]:
        pairs = df.select(_typed(F.col("raw"), dtype, fmt).alias("g"), _convert(F.col("raw"), dtype, fmt).alias("c")).collect()
        def norm(v):
            return "nan" if isinstance(v, float) and v != v else v
        assert [norm(r.g) for r in pairs] == [norm(r.c) for r in pairs], dtype


QUOTED = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b", "c", "d")] + [T.StructField("n", T.IntegerType())])


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_quoting_in_every_profile(spark, tmp_dir, name):
    lines = [
        rb'a,b,c,d,n',
        rb'"x, ""y""","a"",""b",plain,"c:\\dir",1',  # doubled quotes, comma in quotes, a","b, backslashes
        b'"two\nlines","",mid,"end",2',               # quoted line break, quoted empty in the middle
        rb'"",b,c,"",3',                              # quoted empty first and last text field
        rb'NULL,,"  blanks  ",d,""',                  # NULL token, bare empty, trimmed, quoted empty last field
        rb'"say ""hi""",b,c,d,5',
    ]
    p = _write(tmp_dir, f"{name}.csv", b"\n".join(lines) + b"\n")
    rows, rejects = load_csv(spark, p, QUOTED, name)
    backslash = "c:\\dir" if name == "repaired" else "c:\\\\dir"  # only this profile escapes with it
    want = [('x, "y"', 'a","b', "plain", backslash, 1), ("two\nlines", None, "mid", "end", 2), (None, "b", "c", None, 3),
            (None, None, "blanks", "d", None), ('say "hi"', "b", "c", "d", 5)]
    assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted(want, key=str)
    assert rejects.count() == 0


def test_escape_character_in_the_parser(spark, tmp_dir):
    p = _write(tmp_dir, "e.csv", b'id,name,ts\n1,"he said \\"hi\\", ok",\n')
    fmt = PROFILES["repaired"].with_options(doubled_quotes=False)
    assert load_csv(spark, p, SCHEMA, fmt).rows.first().name == 'he said "hi", ok'


def test_load_reconciliation(spark, tmp_dir):
    from starwright.sources.csv_load import load_table
    p = _write(tmp_dir, "r.csv", b'id,name,ts\n1,a,\nx,b,zz\n3,"c\nd",2006-01-01 00:00:00\n4\n')
    target, bad = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "bad")
    r = load_table(spark, p, SCHEMA, target, bad, table_name="r").first()
    assert tuple(r) == ("r", 4, 3, 1, True)
    assert spark.read.parquet(target).count() == 3 and spark.read.parquet(bad).count() == 2  # one row, two bad fields


def test_reconciliation_notices_lost_and_doubled_rows(spark, tmp_dir):
    from pyspark.sql import functions as F
    from starwright.sources.csv_load import load_table, reconcile
    p = _write(tmp_dir, "r.csv", b'id,name,ts\n1,"two\nlines",\n2,b,\n')
    target, bad = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "bad")
    exported = spark.range(2).agg(F.count("*").alias("rows_read"))
    # Without quoted line breaks the first record falls apart: three "rows".
    r = load_table(spark, p, SCHEMA, target, bad, PROFILES["utf8"].with_options(multi_line=False), source=exported).first()
    assert not r.balanced and r.rows_read == 2
    r = load_table(spark, p, SCHEMA, target, bad, source=exported).first()
    assert r.balanced
    rows, rejects = spark.read.parquet(target), spark.read.parquet(bad)
    for other in (rows.limit(1), rows.unionByName(rows)):
        assert not reconcile("r", exported, other, rejects, ["file_name", "record"]).first().balanced


def test_preview_numbers_each_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "stage")
    os.makedirs(d)
    for name, n in (("a.csv", 4), ("b.csv", 12)):
        _write(d, name, b"id,name,ts\n" + b"".join(b"%d,x,\n" % i for i in range(n)))
    pv = preview(spark, d, "flex", n=10).collect()
    per_file = {}
    for r in pv:
        per_file.setdefault(r.file_name, []).append((r.line_number, r.col1))
    assert per_file["a.csv"] == [(i + 1, str(i)) for i in range(4)]
    assert per_file["b.csv"] == [(i + 1, str(i)) for i in range(10)]
