"""Scenario families: which raw label is which scenario, and what is compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenlens.functions import recode_first

# The two reduced-inequality scenarios, matched inside raw labels.
VARIANTS = ("Gini25", "Gini50")


@dataclass(frozen=True)
class ScenarioFamily:
    """How raw labels become `baseline` and the variants.

    `base` is the text that marks the baseline run, found anywhere in the
    label or, with `exact`, equal to it.  Results of a family with a `suffix`
    carry it in the variant names.
    """

    base: str
    baseline: str = "Baseline"
    variants: tuple[str, ...] = VARIANTS
    exact: bool = False
    suffix: str = ""

    @property
    def names(self) -> tuple[str, ...]:
        return (self.baseline, *self.variants)

    def canonical(self, raw: Column | str = "scenario") -> Column:
        rules = [("has", v, v) for v in self.variants]
        rules.append(("is" if self.exact else "has", self.base, self.baseline))
        return recode_first(raw, rules)

    def reported(self, name: str) -> str:
        return name + self.suffix

    def levels(self, name: Column | str = "scenario") -> Column:
        """Canonical name with the suffix of the family, for level tables."""
        name = F.col(name) if isinstance(name, str) else name
        return F.when(name.isin(list(self.names)), F.concat(name, F.lit(self.suffix))).otherwise(name)


# Raw labels of the study's runs.
POLICY_RUNS = ("RegGHGPol_Gini25_Ineq", "RegGHGPol_Gini50_Ineq", "RegGHGPol_Ineq")
POLICY = ScenarioFamily(base="RegGHGPol_Ineq")
POLICY_EXACT = ScenarioFamily(base="RegGHGPol_Ineq", exact=True)
ANY_POLICY = ScenarioFamily(base="RegGHGPol")
REGIONAL_GHG = ScenarioFamily(base="RegGHGPol", baseline="Base")
NO_POLICY = ScenarioFamily(base="Ref_SSP2", suffix="_NoClimPol")
NO_POLICY_INEQ = ScenarioFamily(base="Ref_SSP2_Ineq", suffix="_NoClimPol")
INCOME = ScenarioFamily(base="Ref_SSP2")
COMPLIANCE = ScenarioFamily(base="RegGHGPol", variants=("Gini25", "Gini50", "MinHist"))
