"""Rating arithmetic as column expressions, with the same formulas for single values, and the rulesets."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ruleset:
    """Parameters of one rating run."""

    name: str
    k: float = 20.0
    base: float = 1500.0
    home_advantage: float = 100.0
    scale: float = 400.0
    weight: float = 1.0
    margin: bool = False
    points: float = 28.0
    damp: float = 5.0
    most: float = 1.5


# The three rulesets by name.
RULESETS = {
    "adjusted-v1": Ruleset("adjusted-v1", home_advantage=70.0, margin=True),
    "basic-elo-v1": Ruleset("basic-elo-v1"),
    "point-margin-elo-v1": Ruleset("point-margin-elo-v1", margin=True),
}
# What a parameter may be, ends included (weight is above its lower end).
RANGES = {"k": (1, 100), "base": (500, 2500), "home_advantage": (-200, 300), "scale": (200, 800), "weight": (0, 3), "damp": (1, 20), "most": (1, 3), "points": (5, 100)}


def ruleset(name: str) -> Ruleset:
    try:
        return RULESETS[name]
    except KeyError:
        raise ValueError(f"unknown ruleset {name}") from None


def validate(rules: Ruleset) -> list[str]:
    """What is wrong with the parameters; empty if nothing is."""
    wrong = []
    for name, (low, high) in RANGES.items():
        value = getattr(rules, name)
        if name == "points" and not rules.margin:
            continue
        if not math.isfinite(value) or not (low < value if name == "weight" else low <= value) or value > high:
            wrong.append(f"{name} must be from {low} to {high}")
    return wrong


def custom(base: str = "adjusted-v1", **changes) -> Ruleset:
    """A ruleset with changed parameters; raises if they are out of range."""
    rules = replace(ruleset(base), **changes)
    if wrong := validate(rules):
        raise ValueError("; ".join(wrong))
    return rules


def expected(diff: Column, scale: float = 400.0) -> Column:
    """Probability of a home win from the rating difference with home advantage."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    return 1 / (1 + F.pow(F.lit(10.0), -diff / scale))


def multiplier(home_score: Column, away_score: Column, diff: Column, rules: Ruleset) -> Column:
    """How much a margin raises or lowers the change: by the logarithm of how far the winner beat the margin it was rated for."""
    if not rules.margin:
        return F.lit(1.0)
    margin = (home_score - away_score).cast("double")
    over = F.when(margin > 0, margin - diff / rules.points).otherwise(-margin + diff / rules.points)
    boost = F.least(F.ln(F.abs(over) + 1) / rules.damp, F.lit(rules.most - 1))
    return F.when(over >= 0, F.least(1 + boost, F.lit(rules.most))).otherwise(F.greatest(1 / (1 + boost), F.lit(1 / rules.most)))


def delta(home_score: Column, away_score: Column, diff: Column, rules: Ruleset) -> Column:
    """Change of the home team's rating; null for a draw, which has no rating meaning."""
    won = F.when(home_score > away_score, 1.0).when(home_score < away_score, 0.0)
    return rules.k * (won - expected(diff, rules.scale)) * multiplier(home_score, away_score, diff, rules) * rules.weight


def rate(home_score: int, away_score: int, home: float, away: float, rules: Ruleset) -> tuple[float, float, float]:
    """(expected, multiplier, delta) of one game."""
    if home_score == away_score:
        raise ValueError("a game can't end level")
    if rules.scale <= 0:
        raise ValueError("scale must be positive")
    diff = home + rules.home_advantage - away
    p = 1 / (1 + 10 ** (-diff / rules.scale))
    times = 1.0
    if rules.margin:
        over = (home_score - away_score - diff / rules.points) * (1 if home_score > away_score else -1)
        boost = min(math.log(abs(over) + 1) / rules.damp, rules.most - 1)
        times = min(1 + boost, rules.most) if over >= 0 else max(1 / (1 + boost), 1 / rules.most)
    return p, times, rules.k * ((home_score > away_score) - p) * times * rules.weight
