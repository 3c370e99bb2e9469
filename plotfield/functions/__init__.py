from plotfield.functions.calendar import as_date, season, water_year
from plotfield.functions.missing import (
    any3, count_distinct_with_missing, is_in, not_in, std_error, strict, to_number,
)
from plotfield.functions.recode import (
    KEEP, band, cols_with_prefix, density, label_pairs, level_rank, levels, lookup, non_numeric,
    not_numeric_text, overwrite_when, parity, recode, with_error_bounds, with_levels,
)
from plotfield.functions.text import (
    interaction_key, mean_sd_text, parse_subplot, paste, remove_first, underscores_to_spaces,
)

__all__ = [
    "KEEP", "any3", "as_date", "band", "cols_with_prefix", "count_distinct_with_missing",
    "density", "interaction_key", "is_in", "label_pairs", "level_rank", "levels", "lookup",
    "mean_sd_text", "non_numeric", "not_in", "not_numeric_text", "overwrite_when", "parity",
    "parse_subplot", "paste", "recode", "remove_first", "season", "std_error", "strict",
    "to_number", "underscores_to_spaces", "water_year", "with_error_bounds", "with_levels",
]
