from scenlens.sources.dimensions import (
    code_list,
    food_groups,
    gwp,
    market_regions,
    policy_caps,
    policy_targets,
    region_map,
    with_code_list,
)
from scenlens.sources.files import read_csv, read_csv_after, read_sheets, read_wide_years
from scenlens.sources.project import Project, shared_folder

__all__ = [
    "Project", "code_list", "food_groups", "gwp", "market_regions", "policy_caps",
    "policy_targets", "read_csv", "read_csv_after", "read_sheets", "read_wide_years",
    "region_map", "shared_folder", "with_code_list",
]
