"""Records of delimited files, with their file line numbers, read in splits.

A quoted field may hold line breaks, so a line can only be cut from the next one
by what all lines before it say: is a quote open?  A file need not be read by one
task for that.  A line maps the state before it (outside or inside quotes) to the
state after it; there are four such maps, and they compose:

1. Every split reads its own lines and composes the maps of the lines before each
   line, for both states that the split may begin in (a window over the split).
2. A row per split holds its map, its number of lines and where its last record
   begins; composed along each file, they give the state and the line number that
   a split begins with.
3. Each line now knows its number and its record.  Records of one line, nearly
   all, stay where they are; only the lines of longer ones are brought together.

Maps follow the reader's rules: a field is quoted if it begins with a quote; in
it, a doubled quote (or an escaped one) stands for itself, and a quote that no
delimiter or line end follows does not close it.

Line ends are those of a file's first line, LF or CR LF; CR LF inside a quoted
field of a CR LF file reads as LF.  Files are UTF-8.  A quote that is never closed
makes one record of all that follows it in its file.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.session import ensure_checkpoint_dir


def open_patterns(delimiter: str, quote: str, escape: str | None, skip_space: bool) -> tuple[str, str]:
    """Patterns of the lines after which a quote is open, for a line that begins
    outside quotes and for one that begins inside.  All repetition is possessive:
    it neither backtracks nor recurses, whatever the length of a line."""
    d, q = re.escape(delimiter), re.escape(quote)
    space = rf"[\x00-\x20&&[^{d}]]*+"
    no_close = rf"{q}(?!{space}(?:{d}|\z))"
    if escape is None or escape == quote:
        body = rf"[^{q}]*+(?:(?:{q}{q}|{no_close})[^{q}]*+)*+"
    else:
        e = re.escape(escape)
        body = rf"[^{q}{e}]*+(?:(?:{e}(?:.|\z)|{no_close})[^{q}{e}]*+)*+"
    begin = rf"{space}{q}" if skip_space else q
    field = rf"(?:{begin}{body}{q}{space}|(?!{begin})[^{d}]*+)"
    rest = rf"(?:{field}{d})*+{begin}{body}\z"
    return rf"(?s)\A{rest}", rf"(?s)\A{body}(?:\z|{q}{space}{d}{rest})"


def _maps(value: Column, delimiter: str, quote: str | None, escape: str | None, skip_space: bool) -> tuple[Column, Column]:
    """The state (0 outside, 1 inside) after a line, for either state before."""
    if quote is None:
        return F.lit(0), F.lit(1)
    outside, inside = open_patterns(delimiter, quote, escape, skip_space)
    has = F.contains(value, F.lit(quote)) if escape is None or escape == quote else \
        F.contains(value, F.lit(quote)) | F.contains(value, F.lit(escape))
    state = lambda pattern, plain: F.when(has, value.rlike(pattern).cast("int")).otherwise(F.lit(plain))
    return state(outside, 0), state(inside, 1)


def _composed(df: DataFrame, own: Window, order: str, out: str, into: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}0`` and ``{prefix}1``: the state before a row, if the first
    row begins outside or inside, from the maps (``out``, ``into``) of the rows
    before it.  A map that does not keep or swap states settles the state; after
    the last such row only swaps count."""
    before = own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    until = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    swap = ((F.col(out) == 1) & (F.col(into) == 0)).cast("int")
    df = df.withColumn("__swaps", F.sum(swap).over(until)).withColumn(
        "__settled", F.when(F.col(out) == F.col(into), (F.col(out) + F.col("__swaps")) % 2))
    settled = F.last("__settled", ignorenulls=True).over(before)
    swaps = F.coalesce(F.lag("__swaps").over(own.orderBy(order)), F.lit(0))
    return df.withColumns({f"{prefix}{k}": ((F.coalesce(settled, F.lit(k)) + swaps) % 2).cast("int") for k in (0, 1)}).drop(
        "__swaps", "__settled")


def numbered_lines(spark: SparkSession, path: str, delimiter: str, quote: str | None, escape: str | None,
                   skip_space: bool) -> DataFrame:
    """(file_path, line_number, record, whole, first, value) of all lines:
    ``record`` is the number of the line that the line's record begins with,
    ``whole`` whether the record is this line alone, ``first`` the file's first
    line that is not blank.  The lines are written to a scratch table once."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"))
    out, into = _maps(F.col("value"), delimiter, quote, escape, skip_space)
    lines = lines.withColumns({"out": out, "into": into})
    split = Window.partitionBy("file_path", "block")
    lines = _composed(lines, split, "place", "out", "into", "s")
    until = split.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    index = F.row_number().over(split.orderBy("place"))
    lines = lines.withColumn("idx", index).withColumns({
        f"begin{k}": F.max(F.when(F.col(f"s{k}") == 0, F.col("idx"))).over(until) for k in (0, 1)})
    lines = lines.withColumns({"cr": F.endswith("value", F.lit("\r")), "blank": F.trim(F.rtrim("value", F.lit("\r"))) == ""})
    root = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.drop("place").write.parquet(root)
    lines = spark.read.parquet(root)

    after = lambda k: F.when(F.col(f"s{k}") == 0, F.col("out")).otherwise(F.col("into"))
    splits = lines.groupBy("file_path", "block").agg(
        F.count("*").alias("n"), *[F.max_by(after(k), "idx").alias(f"map{k}") for k in (0, 1)],
        *[F.max(f"begin{k}").alias(f"last{k}") for k in (0, 1)],
        F.min_by("cr", "idx").alias("cr"), F.min(F.when(~F.col("blank"), F.col("idx"))).alias("top"))
    of_file = Window.partitionBy("file_path")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = _composed(splits, of_file, "block", "map0", "map1", "start").withColumn(
        "offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pick = lambda name: F.when(F.col("start0") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    splits = splits.withColumn("begins", F.col("offset") + pick("last")).select(
        "file_path", "block", "start0", "offset", F.last("begins", ignorenulls=True).over(before).alias("open_record"),
        F.first("cr").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("crlf"),
        F.min(F.col("offset") + F.col("top")).over(of_file).alias("top"))
    state = pick("s")
    line = F.col("offset") + F.col("idx")
    value = F.when(F.col("crlf") & F.col("cr"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return lines.drop("cr").join(splits.select("file_path", "block", "start0", "offset", "open_record", "crlf", "top"),
                                 ["file_path", "block"]).withColumn("cr", F.endswith("value", F.lit("\r"))).select(
        "file_path", line.alias("line_number"), F.coalesce(F.col("offset") + pick("begin"), "open_record").alias("record"),
        ((state == 0) & (F.col("out") == 0)).alias("whole"), (line == F.col("top")).alias("first"), value.alias("value"))


def read_records(spark: SparkSession, path: str, delimiter: str = ",", quote: str | None = '"', escape: str | None = None,
                 skip_space: bool = True, header: bool = True) -> DataFrame:
    """(file_path, line_number, raw_record): every record of the files as it
    stands there, and the number (from 1) of the line it begins on.  Blank lines
    between records are none, and the header is left out.

    Records are those of the parser in multi-line mode as long as every quote
    inside a quoted field is doubled (or escaped); quotes inside other fields are
    plain characters."""
    lines = numbered_lines(spark, path, delimiter, quote, escape, skip_space)
    names = ["file_path", F.col("record").alias("line_number")]
    single = lines.where("whole").select(*names, "first", F.col("value").alias("raw_record"))
    longer = lines.where("not whole").groupBy("file_path", "record").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("line_number", "value"))), lambda x: x["value"]), "\n").alias("raw_record"))
    records = single.unionByName(longer.select(*names, "first", "raw_record"))
    if header:
        records = records.where("not first")
    some = F.col("raw_record").rlike(rf"[^\x00-\x20]|{re.escape(delimiter)}") if skip_space else F.col("raw_record") != ""
    return records.where(some).drop("first")
