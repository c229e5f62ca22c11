"""What is modelled: the variables of a study and the terms of one model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

INTERCEPT = "(Intercept)"
PV = "PV"  # stands for the plausible value of the draw being fitted


@dataclass(frozen=True)
class Design:
    """The variables a family of models draws on.

    ``categories`` maps a text column to its levels, reference first;
    ``discrete`` are numbers with few distinct values; ``group_level`` are
    numbers that are constant within a group.
    """

    response: str
    group: str | None
    pv: tuple[str, ...] = ()
    categories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    discrete: tuple[str, ...] = ()
    continuous: tuple[str, ...] = ()
    group_level: tuple[str, ...] = ()

    def row_columns(self) -> list[str]:
        """Design columns that vary within groups, other than the plausible value."""
        dummies = [f"{c}{lv}" for c, levels in self.categories.items() for lv in levels[1:]]
        return [INTERCEPT, *dummies, *self.discrete, *self.continuous]

    def columns(self) -> list[str]:
        """All design columns in storage order; the response comes last, outside this list."""
        return [*self.row_columns(), *([PV] if self.pv else []), *self.group_level]

    def expand(self, terms: Sequence[str]) -> list[str]:
        """Design columns of a list of variables."""
        out = []
        for t in terms:
            if t in self.categories:
                out += [f"{t}{lv}" for lv in self.categories[t][1:]]
            else:
                out.append(t)
        return out


@dataclass(frozen=True)
class ModelSpec:
    """Fixed variables (the intercept is implied) and random slopes of one model."""

    name: str
    fixed: tuple[str, ...]
    slopes: tuple[str, ...] = ()

    def fixed_columns(self, design: Design) -> list[str]:
        return [INTERCEPT, *design.expand(self.fixed)]

    def random_columns(self, design: Design) -> list[str]:
        return [INTERCEPT, *design.expand(self.slopes)]

    def group_level(self, design: Design) -> list[str]:
        return [t for t in self.fixed if t in design.group_level]
