from plotfield.operators.groups import earliest_rows, first_seen, keep_groups_any
from plotfield.operators.joins import (
    anti_join, complete, grid, grid_over, inner_join, left_join, lookup_join, member_flag,
    semi_join,
)
from plotfield.operators.order import arrange, first_rows, with_position
from plotfield.operators.quantiles import box_outliers, box_stats, exact_quantiles
from plotfield.operators.reshape import longer, longer_values, separate, wider
from plotfield.operators.summarise import (
    contingency, distinct_rows, duplicate_keys, entity_mean, mean_sd_table, mean_se, null_count,
    pool_se, proportion_se, rates, summarise_across, var_table, zscore,
)
from plotfield.operators.unions import add_baseline, union_fill, union_strict

__all__ = [
    "add_baseline", "anti_join", "arrange", "box_outliers", "box_stats", "complete", "contingency",
    "distinct_rows", "duplicate_keys", "earliest_rows", "entity_mean", "exact_quantiles",
    "first_rows", "first_seen", "grid", "grid_over", "inner_join", "keep_groups_any", "left_join",
    "longer", "longer_values", "lookup_join", "mean_sd_table", "mean_se", "member_flag",
    "null_count", "pool_se", "proportion_se", "rates", "semi_join", "separate",
    "summarise_across", "union_fill", "union_strict", "var_table", "wider", "with_position", "zscore",
]
