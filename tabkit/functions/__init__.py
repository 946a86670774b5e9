from tabkit.functions.missing import (
    MISSING_TOKENS,
    is_complete,
    is_missing,
    is_text_nan,
    not_equal_keep_null,
)
from tabkit.functions.numbers import as_double, as_int, as_number, ratio, to_type
from tabkit.functions.temporal import (
    WEEKDAYS_ES,
    date_field_by_position,
    month_of_date,
    parse_date,
    time_bucket,
    weekday_name,
)

__all__ = [
    "MISSING_TOKENS",
    "WEEKDAYS_ES",
    "as_double",
    "as_int",
    "as_number",
    "date_field_by_position",
    "is_complete",
    "is_missing",
    "is_text_nan",
    "month_of_date",
    "not_equal_keep_null",
    "parse_date",
    "ratio",
    "time_bucket",
    "to_type",
    "weekday_name",
]
