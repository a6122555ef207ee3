from themeloom.functions.columns import (
    AMOUNT_SCALE,
    LOADING_SCALE,
    any_flag,
    blank_to_null,
    digest_number,
    exact,
    first_match,
    if_else,
    in_set,
    matches_any,
    mean_type,
    percent,
    reaches_mean,
    to_fixed,
    to_number,
    years_between,
)

__all__ = [
    "AMOUNT_SCALE",
    "LOADING_SCALE",
    "any_flag",
    "blank_to_null",
    "digest_number",
    "exact",
    "first_match",
    "if_else",
    "in_set",
    "matches_any",
    "mean_type",
    "percent",
    "reaches_mean",
    "to_fixed",
    "to_number",
    "years_between",
]
