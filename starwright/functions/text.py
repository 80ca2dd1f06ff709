"""Text expressions used by the dashboard marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_label(name: str, prefix: str = "") -> str:
    """Label of a column name: without its prefix (found in any case, taken
    off by length), words in title case: 'FILM_IN_CATEGORY_SCIFI' -> 'Scifi',
    'film_in_category_80s' -> '80s'.  Blanks separate words."""
    if prefix and name.lower().startswith(prefix.lower()):
        name = name[len(prefix):]
    return " ".join(w[:1].upper() + w[1:].lower() for w in name.split(" "))


def full_name(first: Column | str, last: Column | str) -> Column:
    """'first last' with blanks for NULL parts, outer blanks stripped."""
    return F.trim(F.concat_ws(" ", F.coalesce(_c(first), F.lit("")), F.coalesce(_c(last), F.lit(""))))


def store_label(store_id: Column | str, first: Column | str, last: Column | str) -> Column:
    """'Store {id} ({first} {last})'; NULL name parts print as blanks,
    never as 'nan'.  NULL id gives a NULL label instead of failing."""
    return F.trim(F.concat(
        F.lit("Store "), _c(store_id).cast("string"), F.lit(" ("),
        F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")), F.lit(")"),
    ))


def money_text(c: Column | str) -> Column:
    """'$1,234.56' display text; numbers stay numeric in the marts."""
    return F.concat(F.lit("$"), F.format_number(_c(c), 2))


def is_utf8(c: Column | str) -> Column:
    """True when the value (text, or binary taken as text) is valid UTF-8."""
    return F.is_valid_utf8(_c(c).cast("string"))


def repair_utf8(c: Column | str) -> Column:
    """Replace invalid UTF-8 sequences with U+FFFD (binary input is taken as
    text first; valid text is returned unchanged)."""
    return F.make_valid_utf8(_c(c).cast("string"))
