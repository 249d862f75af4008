"""How deep a research run goes: each layer at a light, a medium or a heavy depth."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from ..operators.labels import Target
from ..operators.models import Params
from ..operators.patterns import Profile

LIGHT, MEDIUM, HEAVY = 10, 20, 40

#: Formations that are looked for: name, confirming bars, least and greatest gap, tolerance and rebound in bps. Fixed values.
PROFILES = (
    Profile("micro", 1, 3, 30, 15, 20),
    Profile("short", 2, 5, 60, 20, 30),
    Profile("intraday", 3, 8, 120, 25, 40),
    Profile("swing", 5, 15, 240, 35, 60),
    Profile("macro_intraday", 8, 30, 480, 50, 100),
    Profile("macro", 13, 60, 960, 70, 150),
)
#: Outcomes: take profit and stop loss in bps, horizon in minutes. Fixed values.
TARGETS = tuple(
    Target(*t)
    for t in (
        (25, 20, 30), (50, 25, 60), (75, 25, 120), (100, 30, 240), (125, 35, 240), (150, 40, 360), (200, 50, 480), (250, 60, 720),
        (300, 75, 720), (400, 100, 1440), (500, 125, 1440), (750, 175, 2880), (1000, 250, 4320), (1250, 300, 4320), (1500, 350, 5760), (2000, 500, 10080),
    )
)
#: Look-backs in minutes by depth. Fixed values.
LOOKBACKS = {LIGHT: (1, 5, 15, 60), MEDIUM: (1, 3, 5, 15, 30, 60, 240), HEAVY: (1, 3, 5, 10, 15, 30, 60, 120, 240, 480, 1440)}
#: Folds, share held out, share of the first training part, permutations, probability bins. Fixed values.
VALIDATION = {LIGHT: (3, 0.15, 0.45, 3, 5), MEDIUM: (5, 0.20, 0.45, 8, 10), HEAVY: (8, 0.20, 0.40, 15, 15)}
#: Boosting parameters to choose between: own choices, as tree depth stands in for a number of leaves.
MODELS = tuple(Params(depth, rounds, rate, leaf) for (depth, leaf), (rounds, rate) in itertools.product(((3, 20), (4, 30), (5, 40), (5, 80)), ((20, 0.15), (40, 0.08), (60, 0.05), (90, 0.03))))


def depth_of(level: int) -> int:
    """The depth that a level from 1 on means."""
    return LIGHT if level <= 14 else MEDIUM if level <= 29 else HEAVY


@dataclass(frozen=True)
class Preset:
    profiles: tuple[Profile, ...]
    lookbacks: tuple[int, ...]
    targets: tuple[Target, ...]
    folds: int
    holdout: float
    first_train: float
    models: tuple[Params, ...]
    permutations: int
    bins: int


def preset(geometry: int = MEDIUM, features: int = MEDIUM, outcomes: int = MEDIUM, validation: int = MEDIUM, model_search: int = MEDIUM, stability: int = MEDIUM) -> Preset:
    folds, holdout, first, _, _ = VALIDATION[depth_of(validation)]
    *_, permutations, bins = VALIDATION[depth_of(stability)]
    pick = lambda values, level, counts: values[: counts[(LIGHT, MEDIUM, HEAVY).index(depth_of(level))]]
    return Preset(pick(PROFILES, geometry, (2, 4, 6)), LOOKBACKS[depth_of(features)], pick(TARGETS, outcomes, (4, 8, 16)), folds, holdout, first, pick(MODELS, model_search, (3, 8, 16)), permutations, bins)
