"""Delimited-file loading into a declared schema with a rejects table.

A load reads every field as text, applies the profile's NULL / trim
rules, then converts each field with ``try_*`` casts.  A row whose
non-NULL field fails to convert is rejected (with file, column, raw value
and reason) and the rest of the file still loads.  Short rows are padded
with NULL and extra fields dropped; that alone is not an error.

With ``numbered=True`` files are read in splits even where quoted fields hold
line breaks (:mod:`starwright.sources.records`), and rejects carry the record as
it stands in the file and the number of the line it begins on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.functions.flags import null_if_tokens
from starwright.sources.records import read_records
from starwright.sources.sinks import write_table


@dataclass(frozen=True)
class CsvFormat:
    """A named, immutable set of reader rules."""

    name: str
    delimiter: str = ","
    quote: str | None = '"'
    escape: str | None = None
    header: bool = True
    null_if: tuple[str, ...] = ()
    empty_as_null: bool = True
    trim_space: bool = True
    replace_invalid: bool = True
    encoding: str = "UTF-8"
    date_format: str = "yyyy-MM-dd"
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"
    # Doubled quotes stand for a quote in every profile; a profile's escape
    # character is undone after parsing.  False hands the escape character to
    # the parser instead (needed where an escaped quote stands right before a
    # delimiter), which then does not know doubled quotes.
    doubled_quotes: bool = True
    # Quoted line breaks belong to the field.  Such files are read by one task
    # each; turn it off for large files known to hold none.
    multi_line: bool = True

    def with_options(self, **changes) -> "CsvFormat":
        return replace(self, **changes)


# FIXED VALUES -- the reference's file-format profiles (delimiter, enclosure,
# escape, header skip, NULL tokens, trimming, invalid-UTF-8 replacement).
PROFILES = {
    "flex": CsvFormat("flex", null_if=("", "NULL", "null", "N", '"N"'), replace_invalid=False),
    "utf8": CsvFormat("utf8", null_if=("", "NULL", "null", "N", '"N"'), replace_invalid=False),
    "repaired": CsvFormat("repaired", escape="\\", null_if=("", "NULL", "null", "N", '"N"', '"N', "N,")),
    "final": CsvFormat("final", null_if=("", "NULL", "null", "N", '"N"', "N,")),
    "format": CsvFormat("format", null_if=("NULL", "N", ""), replace_invalid=False,
                        date_format="yyyy-MM-dd", timestamp_format="yyyy-MM-dd HH:mm:ss"),
}

# A bare 'N' token also erases a genuine value 'N'; it is honoured only
# when a load asks for it.
BARE_N_TOKEN = "N"


# What names a record of a file, and the record itself.
_RECORD = ["file_path", "line_number", "raw_record"]


class LoadResult(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def profile(name: str) -> CsvFormat:
    return PROFILES[name]


def null_tokens(fmt: CsvFormat, bare_n_is_null: bool = False) -> tuple[str, ...]:
    tokens = [t for t in fmt.null_if if bare_n_is_null or t != BARE_N_TOKEN]
    if fmt.empty_as_null and "" not in tokens:
        tokens.append("")
    return tuple(tokens)


def reader_options(fmt: CsvFormat) -> dict[str, str]:
    """Reader options of a profile (shared by batch and streaming reads)."""
    return {
        "sep": fmt.delimiter, "header": str(fmt.header).lower(), "encoding": fmt.encoding,
        "mode": "PERMISSIVE", "multiLine": str(fmt.multi_line).lower(),
        "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE",
        "ignoreLeadingWhiteSpace": str(fmt.trim_space).lower(),
        "ignoreTrailingWhiteSpace": str(fmt.trim_space).lower(),
        # NULL tokens are applied afterwards, from the profile's list.
        "nullValue": "\u0000", "emptyValue": "",
        "quote": fmt.quote if fmt.quote is not None else "\u0000",
        "escape": _parser_escape(fmt),
    }


def _parser_escape(fmt: CsvFormat) -> str:
    escape = fmt.quote if fmt.doubled_quotes else fmt.escape
    return escape if escape is not None else "\u0000"


def _reader(spark: SparkSession, fmt: CsvFormat):
    return spark.read.format("csv").options(**reader_options(fmt))


def read_text_fields(
    spark: SparkSession, path: str, columns: list[str], fmt: CsvFormat, by_name: bool = False,
) -> DataFrame:
    """All fields as strings, bound by position (default) or by header name."""
    if by_name:
        raw = _reader(spark, fmt).option("header", "true").option("inferSchema", "false").load(path)
        present = {c.lower(): c for c in raw.columns}
        cols = [
            (F.col(f"`{present[c.lower()]}`") if c.lower() in present else F.lit(None).cast("string")).alias(c)
            for c in columns
        ]
        df = raw.select(*cols, F.col("_metadata.file_name").alias("__sw_file"))
    else:
        schema = text_schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        raw = _reader(spark, fmt).option("enforceSchema", "true").schema(schema).load(path)
        df = raw.select(*columns, F.col("_metadata.file_name").alias("__sw_file"))
    return df


def read_numbered_fields(
    spark: SparkSession, path: str, columns: list[str], fmt: CsvFormat, by_name: bool = False,
) -> DataFrame:
    """The fields of :func:`read_text_fields` with file_path, line_number and
    raw_record instead of the file's name."""
    if fmt.encoding.upper().replace("-", "") != "UTF8":
        raise ValueError("numbered records are read as UTF-8")
    records = read_records(spark, path, fmt.delimiter, fmt.quote, _record_escape(fmt), fmt.trim_space, fmt.header or by_name)
    stored = columns
    if by_name:  # the header alone is parsed here
        stored = _reader(spark, fmt).option("header", "true").option("inferSchema", "false").load(path).columns
    ddl = ", ".join(f"c{k} string" for k in range(len(stored)))
    opts = {k: v for k, v in reader_options(fmt).items() if k not in ("header", "encoding", "multiLine")}
    parsed = records.withColumn("__sw_fields", F.from_csv("raw_record", ddl, opts))
    place = {c.lower(): k for k, c in enumerate(stored)}
    field = lambda c: F.col(f"__sw_fields.c{place[c.lower()]}") if c.lower() in place else F.lit(None).cast("string")
    return parsed.select("file_path", "line_number", "raw_record", *[field(c).alias(c) for c in columns])


def _record_escape(fmt: CsvFormat) -> str | None:
    return None if fmt.doubled_quotes else fmt.escape


# Guards: each pattern matches a superset of the text the conversion can
# accept, so guarding never changes a result; text outside it is NULL at
# once instead of failing inside the cast, which is far slower per row.
_PAD = r"[\s\p{Z}\p{C}]*"
_GUARDS = {
    "integral": rf"^{_PAD}[+-]?([0-9]+\.?[0-9]*|\.[0-9]+){_PAD}$",
    "fractional": r"[0-9]|(?i)inf|(?i)nan",
    "boolean": rf"(?i)^{_PAD}(t|true|y|yes|1|f|false|n|no|0){_PAD}$",
    "datetime": r"[0-9]",
}


def _guard(raw: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return raw.rlike(_GUARDS["integral"])
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return raw.rlike(_GUARDS["fractional"])
    if isinstance(dtype, T.BooleanType):
        return raw.rlike(_GUARDS["boolean"])
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return raw.rlike(_GUARDS["datetime"])
    return None


def _convert(raw: Column, dtype: T.DataType, fmt: CsvFormat) -> Column:
    if isinstance(dtype, T.DateType):
        return F.try_to_date(raw, fmt.date_format)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(raw, F.lit(fmt.timestamp_format)).cast(dtype)
    return raw.try_cast(dtype)


def _typed(raw: Column, dtype: T.DataType, fmt: CsvFormat) -> Column:
    if isinstance(dtype, T.StringType):
        return raw
    guard = _guard(raw, dtype)
    conv = _convert(raw, dtype, fmt)
    return conv if guard is None else F.when(guard, conv)


def clean_fields(text: DataFrame, schema: T.StructType, fmt: CsvFormat, bare_n_is_null: bool = False) -> DataFrame:
    """Apply the profile's trimming, UTF-8 repair and NULL tokens to the
    string fields named by ``schema`` (other columns pass through)."""
    tokens = null_tokens(fmt, bare_n_is_null)
    cols = {}
    for f in schema.fields:
        c = F.col(f.name)
        if fmt.escape is not None and fmt.doubled_quotes:
            # The parser knew doubled quotes only: undo the escape character.
            c = F.regexp_replace(c, rf"\Q{fmt.escape}\E(.)", "$1")
        if fmt.trim_space:
            c = F.trim(c)
        if fmt.replace_invalid:
            c = F.make_valid_utf8(c)
        cols[f.name] = null_if_tokens(c, tokens)
    return text.withColumns(cols)


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: CsvFormat | str = "utf8",
    by_name: bool = False,
    bare_n_is_null: bool = False,
    numbered: bool = False,
) -> LoadResult:
    """Load delimited files into ``schema``; returns (rows, rejects).

    ``rejects`` has one row per field that failed to convert:
    (file_name, column_name, raw_value, reason).  Both frames are lazy, and
    each reads the files once; :func:`load_table` writes both and reconciles
    them.  ``numbered``: rejects have (file_path, line_number, raw_record,
    column_name, raw_value, reason), and the files are read once, right away,
    into a scratch table of lines."""
    if isinstance(fmt, str):
        fmt = profile(fmt)
    names = [f.name for f in schema.fields]
    if numbered:
        text = clean_fields(read_numbered_fields(spark, path, names, fmt, by_name), schema, fmt, bare_n_is_null)
        rows, rejects = split_typed(text, _RECORD, schema, fmt)
        return LoadResult(rows.drop(*_RECORD), rejects)
    text = read_text_fields(spark, path, names, fmt, by_name=by_name)
    text = clean_fields(text, schema, fmt, bare_n_is_null).withColumnRenamed("__sw_file", "file_name")
    rows, rejects = split_typed(text, ["file_name"], schema, fmt)
    return LoadResult(rows.drop("file_name"), rejects)


def split_typed(df: DataFrame, key: list[str], fields: T.StructType, fmt: CsvFormat | str = "format") -> LoadResult:
    """The conversion half of :func:`load_csv` for an already-read text frame:
    ``fields`` names string columns of ``df`` and their target types.
    Returns (rows with key + typed fields, rejects with key + column_name,
    raw_value, reason).

    Written without lambdas, so both outputs stay in whole-stage codegen:
    a row passes when no field failed; only failing rows expand into one
    reject per failed field."""
    if isinstance(fmt, str):
        fmt = profile(fmt)
    typed = {f.name: _typed(F.col(f.name), f.dataType, fmt) for f in fields.fields}
    bad = {f.name: F.col(f.name).isNotNull() & typed[f.name].isNull() for f in fields.fields}
    any_bad = F.lit(False)
    for b in bad.values():
        any_bad = any_bad | b
    rows = df.where(~any_bad).select(*key, *[typed[f.name].alias(f.name) for f in fields.fields])
    findings = F.array(*[
        F.when(bad[f.name], F.struct(
            F.lit(f.name).alias("column_name"), F.col(f.name).alias("raw_value"),
            F.lit(f"cannot convert to {f.dataType.simpleString()}").alias("reason")))
        for f in fields.fields
    ])
    rejects = (
        df.where(any_bad).select(*key, F.explode(findings).alias("e")).where(F.col("e").isNotNull())
        .select(*key, "e.column_name", "e.raw_value", "e.reason")
    )
    return LoadResult(rows, rejects)


def count_records(spark: SparkSession, path: str, fmt: CsvFormat | str = "utf8") -> DataFrame:
    """One row (rows_read): the records of the files, with no schema or
    conversion applied."""
    if isinstance(fmt, str):
        fmt = profile(fmt)
    record = T.StructType([T.StructField("record", T.StringType())])
    raw = _reader(spark, fmt).option("enforceSchema", "true").schema(record).load(path)
    # The file name keeps the scan from being answered without parsing.
    return raw.select("record", F.col("_metadata.file_name").alias("f")).agg(F.count("f").alias("rows_read"))


def reconcile(table_name: str, source: DataFrame, target: DataFrame, rejects: DataFrame,
              record: list[str]) -> DataFrame:
    """(table_name, rows_read, rows_loaded, rows_rejected, balanced): whether the
    rows counted at the source (``source``: one row ``rows_read``) are those in
    the target plus the rejected records (each counts once however many of its
    fields failed; ``record`` names the columns that identify it).

    The three counts come from different tables, so rows lost or doubled on
    the way show."""
    parts = [
        source.select(F.lit("read").alias("what"), F.col("rows_read").cast("long").alias("n")),
        target.agg(F.count(F.lit(1)).alias("n")).select(F.lit("loaded").alias("what"), "n"),
        rejects.select(*record).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("what"), "n"),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    counts = stacked.agg(of("read").alias("rows_read"), of("loaded").alias("rows_loaded"),
                         of("rejected").alias("rows_rejected"))
    return counts.select(
        F.lit(table_name).alias("table_name"), "rows_read", "rows_loaded", "rows_rejected",
        (F.col("rows_read") == F.col("rows_loaded") + F.col("rows_rejected")).alias("balanced"))


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    target: str,
    rejects: str,
    fmt: CsvFormat | str = "utf8",
    table_name: str | None = None,
    by_name: bool = False,
    bare_n_is_null: bool = False,
    source: DataFrame | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Load files into the Parquet table ``target`` and their rejects into
    ``rejects`` (file_name, record, column_name, raw_value, reason), each from
    its own pass over the files, and return the reconciliation of what was
    written.  ``source`` (one row ``rows_read``) may give the number of rows
    that were exported; by default the records of the files are counted.
    ``numbered``: as in :func:`load_csv`, with file_path, line_number and
    raw_record in place of file_name and record."""
    if isinstance(fmt, str):
        fmt = profile(fmt)
    names = [f.name for f in schema.fields]
    if numbered:
        fields = read_numbered_fields(spark, path, names, fmt, by_name)
        rows, bad = split_typed(clean_fields(fields, schema, fmt, bare_n_is_null), _RECORD, schema, fmt)
        write_table(rows.drop(*_RECORD), target)
        write_table(bad, rejects)
        read = fields.agg(F.count("line_number").alias("rows_read")) if source is None else source
        return reconcile(table_name or path, read, spark.read.parquet(target), spark.read.parquet(rejects), _RECORD[:2])
    text = read_text_fields(spark, path, names, fmt, by_name=by_name)
    text = clean_fields(text, schema, fmt, bare_n_is_null).withColumnRenamed("__sw_file", "file_name")
    # A record's number holds for one pass, and all its rejects are of one pass.
    text = text.withColumn("record", F.monotonically_increasing_id())
    rows, bad = split_typed(text, ["file_name", "record"], schema, fmt)
    write_table(rows.drop("file_name", "record"), target)
    write_table(bad, rejects)
    return reconcile(table_name or path, source if source is not None else count_records(spark, path, fmt),
                     spark.read.parquet(target), spark.read.parquet(rejects), ["file_name", "record"])


def text_schema(schema: T.StructType) -> T.StructType:
    """The all-string reading schema of a target schema."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


def preview(spark: SparkSession, path: str, fmt: CsvFormat | str = "flex", n: int = 10, fields: int = 6) -> DataFrame:
    """File name, line number and the first ``fields`` fields of the first
    ``n`` data lines of every file (header lines skipped when the profile
    has a header).

    Each file's first split is read (``file_block_start = 0``), and more of a
    file only where its lines are so long that the split holds too few; the
    per-file row limit is applied before any shuffle."""
    if isinstance(fmt, str):
        fmt = profile(fmt)
    skip = 1 if fmt.header else 0
    numbered = _first_lines(spark, path, n, skip)
    ddl = ", ".join(f"col{i + 1} string" for i in range(fields))
    opts = {"sep": fmt.delimiter, "quote": fmt.quote or "\u0000", "escape": _parser_escape(fmt)}
    parsed = numbered.select("file_name", "line_number", F.from_csv("value", ddl, opts).alias("f"))
    return parsed.select("file_name", "line_number", *[F.col(f"f.col{i + 1}") for i in range(fields)]) \
        .orderBy("file_name", "line_number")


def preview_raw(spark: SparkSession, path: str, n: int = 3, skip_header: bool = True,
                delimiter: str = "\t") -> DataFrame:
    """The first field (column ``value``) of the first ``n`` lines of every
    file, its header line skipped: (file_name, line_number, value).  With a
    delimiter that the lines do not hold, the field is the whole line."""
    lines = _first_lines(spark, path, n, 1 if skip_header else 0)
    return lines.select("file_name", "line_number", F.split_part("value", F.lit(delimiter), F.lit(1)).alias("value")) \
        .orderBy("file_name", "line_number")


def _first_lines(spark: SparkSession, path: str, n: int, skip: int) -> DataFrame:
    """(file_name, line_number, value) of the first ``n`` lines after ``skip``
    ones of every file."""

    def lines(paths) -> DataFrame:
        return spark.read.text(paths).select(
            "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block"),
            (F.col("_metadata.file_size") > F.col("_metadata.file_block_length")).alias("more"),
            F.monotonically_increasing_id().alias("__sw_pos"))

    def numbered(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("file_path").orderBy("block", "__sw_pos")
        return df.withColumn("line_number", F.row_number().over(w)).where(F.col("line_number") <= n + skip).select(
            "file_path", "file_name", "line_number", "value")

    begins = lines(path).where("block = 0")
    few = begins.where("more").groupBy("file_path").agg(F.count("*").alias("n")).where(F.col("n") < n + skip)
    long = sorted(r[0] for r in few.select("file_path").collect())  # files of very long lines only
    out = numbered(begins)
    if long:
        out = out.where(~F.col("file_path").isin(long)).unionByName(numbered(lines(long)))
    return out.where(F.col("line_number") > skip).select(
        "file_name", (F.col("line_number") - skip).alias("line_number"), "value")
