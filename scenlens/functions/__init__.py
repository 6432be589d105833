from scenlens.functions.nulls import (
    absent_as_zero,
    choose,
    contains,
    half_even,
    not_in_nor_null,
    number_text,
    safe_div,
    strict_avg,
    strict_sum,
    strict_sum_where,
    sum0,
)
from scenlens.functions.recode import ordinal, patch, recode_first, recode_last
from scenlens.functions.text import alnum_piece, separator_piece, split_decile, split_last

__all__ = [
    "absent_as_zero", "alnum_piece", "choose", "contains", "half_even", "not_in_nor_null",
    "number_text", "ordinal", "patch", "recode_first", "recode_last", "safe_div",
    "separator_piece", "split_decile", "split_last", "strict_avg", "strict_sum",
    "strict_sum_where", "sum0",
]
