"""All registered queries."""

from __future__ import annotations

from testbed.entry import Entry
from testbed.operators import OPS
from testbed.results_energy import ENERGY, FOOD
from testbed.results_other import OTHER

ENTRIES: dict[str, Entry] = {**OPS, **ENERGY, **FOOD, **OTHER}
