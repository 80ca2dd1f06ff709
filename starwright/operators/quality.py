"""Constraint validation jobs: declared keys, references, NOT NULL and
domains checked as Spark jobs over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, key: str | Sequence[str], alias: str = "copies") -> DataFrame:
    """Key values held by more than one row, with their number of copies.

    Partial aggregation combines copies map-side, so a hot key costs one
    row per partition in the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))
        .where(F.col(alias) > 1)
    )


def check_orphans(child: DataFrame, parent: DataFrame, child_key: str | Sequence[str],
                  parent_key: str | Sequence[str] | None = None) -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent row.

    The parent side is reduced to its distinct keys before the anti join
    (map-side de-duplication), and child rows with a NULL reference are
    exempt, as under a declared foreign key."""
    ck = [child_key] if isinstance(child_key, str) else list(child_key)
    pk = ck if parent_key is None else ([parent_key] if isinstance(parent_key, str) else list(parent_key))
    keys = parent.select(*[F.col(p).alias(f"__sw_pk{i}") for i, p in enumerate(pk)]).distinct()
    cond = [child[c] == keys[f"__sw_pk{i}"] for i, c in enumerate(ck)]
    src = child
    for c in ck:
        src = src.where(F.col(c).isNotNull())
    return src.join(keys, cond, "left_anti")


def check_not_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, nulls) for each column, computed in one pass."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "nulls")


def domain_reasons(lengths: Mapping[str, int] | None = None,
                   decimals: Mapping[str, tuple[int, int]] | None = None) -> list[tuple[str, Column]]:
    """(column, reason) pairs; a reason is NULL when the value fits:
    ``too_long`` (more than n characters), ``overflow`` (does not fit
    DECIMAL(p, s)) or ``scale`` (fits only after rounding, which a cast
    would do silently)."""
    checks = []
    for col, n in (lengths or {}).items():
        checks.append((col, F.when(F.length(F.col(col)) > n, F.lit("too_long"))))
    for col, (p, s) in (decimals or {}).items():
        fitted = F.col(col).try_cast(f"decimal({p},{s})")
        checks.append((col, F.when(F.col(col).isNotNull() & fitted.isNull(), F.lit("overflow"))
                       .when(fitted.isNotNull() & (fitted.cast("double") != F.col(col).cast("double")),
                             F.lit("scale"))))
    return checks


def check_domain(
    df: DataFrame,
    key: str | Sequence[str],
    lengths: Mapping[str, int] | None = None,
    decimals: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Rows whose value does not fit the declared type: (key...,
    column_name, reason), reasons as in :func:`domain_reasons`."""
    keys = [key] if isinstance(key, str) else list(key)
    checks = domain_reasons(lengths, decimals)
    if not checks:
        raise ValueError("no domain checks given")
    # One scan, no lambdas (stays in codegen): rows with any finding expand
    # into one row per (column, reason); empty slots are dropped.
    any_finding = F.lit(False)
    for _, reason in checks:
        any_finding = any_finding | reason.isNotNull()
    findings = F.array(*[
        F.when(reason.isNotNull(), F.struct(F.lit(col).alias("column_name"), reason.alias("reason")))
        for col, reason in checks
    ])
    return (
        df.where(any_finding).select(*keys, F.explode(findings).alias("__sw_f")).where(F.col("__sw_f").isNotNull())
        .select(*keys, F.col("__sw_f.column_name").alias("column_name"), F.col("__sw_f.reason").alias("reason"))
    )


def violation_counts(
    df: DataFrame,
    not_null: Sequence[str] = (),
    lengths: Mapping[str, int] | None = None,
    decimals: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """NULLs in NOT NULL columns and domain violations, counted in one pass:
    (check, column_name, violations) rows."""
    parts = [("not_null", c, F.count_if(F.col(c).isNull())) for c in not_null]
    parts += [("domain", c, F.count_if(reason.isNotNull())) for c, reason in domain_reasons(lengths, decimals)]
    if not parts:
        raise ValueError("nothing to count")
    wide = df.agg(*[e.cast("long").alias(f"c{i}") for i, (_, _, e) in enumerate(parts)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(col).alias("column_name"), F.col(f"c{i}").alias("violations"))
        for i, (check, col, _) in enumerate(parts)
    ]))
    return wide.select(stacked.alias("v")).select("v.check", "v.column_name", "v.violations")


def orphan_counts(child: DataFrame, references: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Orphans of every reference of a table in one pass over it: (column_name,
    violations).  ``references``: child column -> (parent, parent column).
    NULL references are exempt.  Each parent is reduced to its distinct keys and
    left-joined, so rows neither vanish nor multiply."""
    df = child.select(*references)
    for i, (col, (parent, pcol)) in enumerate(references.items()):
        keys = parent.select(F.col(pcol).alias(f"__sw_p{i}")).where(F.col(pcol).isNotNull()).distinct()
        df = df.join(keys, df[col] == keys[f"__sw_p{i}"], "left")
    wide = df.agg(*[F.count_if(F.col(col).isNotNull() & F.col(f"__sw_p{i}").isNull()).cast("long").alias(col)
                    for i, col in enumerate(references)])
    return wide.unpivot([], list(references), "column_name", "violations")


def content_sum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (rows, content): an order-free fingerprint of a table, the exact
    sum of 60-bit hashes of its rows.  Rows count as often as they occur; a NULL
    is told apart from every text, and a value from its neighbours.  It takes one
    pass and one row per task, so two tables are compared without a join."""
    shown = [F.col(c).cast("string") for c in (columns or df.columns)]
    told = F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown])
    row = F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("decimal(28,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("content"))


def compare_content(table_name: str, source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows and content of a source and of what was written from it, and
    whether they agree.  A value that changed on the way shows, also where all
    counts are equal."""
    of = lambda df, side: content_sum(df, columns or source.columns).select(
        F.lit(table_name).alias("table_name"), F.col("rows").alias(f"rows_{side}"), F.col("content").alias(f"content_{side}"))
    both = of(source, "source").join(of(target, "target"), "table_name")
    return both.withColumn("balanced", (F.col("rows_source") == F.col("rows_target"))
                           & (F.col("content_source") == F.col("content_target")))
