from scenlens.operators.classing import fixed_class, kmeans_class, pretty_class
from scenlens.operators.compare import change, compare, gap_to_target, net_and_relative, spread
from scenlens.operators.densify import annual_series
from scenlens.operators.fit import fit_line
from scenlens.operators.inequality import decile_gini, decile_shares, palma, split_equally
from scenlens.operators.joins import (
    broadcast_if_small,
    cross_with,
    inline_table,
    lookup,
    strict_lookup,
    unmatched,
    verified_key,
)
from scenlens.operators.reshape import (
    DuplicateCell,
    pivot_cells,
    pivot_sums,
    sum_by,
    to_long,
    union_all,
    year_window,
)
from scenlens.operators.rollup import share_of_group, to_aggregate_region, with_group_total

__all__ = [
    "DuplicateCell", "annual_series", "broadcast_if_small", "change", "compare", "cross_with", "decile_gini",
    "decile_shares", "fit_line", "fixed_class", "gap_to_target", "inline_table",
    "kmeans_class", "lookup", "net_and_relative", "palma", "pivot_cells", "pivot_sums", "pretty_class", "share_of_group",
    "split_equally", "spread", "strict_lookup", "sum_by", "to_aggregate_region", "to_long",
    "union_all", "unmatched", "verified_key", "with_group_total", "year_window",
]
