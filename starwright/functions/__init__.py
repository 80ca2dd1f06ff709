"""Column expressions: everything here returns a ``Column`` and stays
inside whole-stage codegen (no Python UDFs)."""

from starwright.functions.dates import (  # noqa: F401
    calendar_columns, date_key, epoch_seconds, iso_week, month_start,
)
from starwright.functions.flags import (  # noqa: F401
    contains_flags, flag_not_null, is_truthy, null_if_tokens, one_hot, safe_div,
)
from starwright.functions.money import cents, from_cents, money_sum  # noqa: F401
from starwright.functions.text import (  # noqa: F401
    full_name, is_utf8, money_text, repair_utf8, store_label, title_label,
)
