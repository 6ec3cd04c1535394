"""Targets, servings, penalties and scores as column expressions.

Every tunable is an argument, so a sweep is a join with a parameter table and no
state is shared between queries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.functions.numeric import clamp, half_even

#: Shares, gates, weights and limits of the scoring model.
SLOT_SHARE = {"breakfast": 0.25, "lunch": 0.35, "dinner": 0.40}
WEIGHTS = {"relevance": 1.0, "energy": 0.4, "macros": 0.3, "repetition": 0.2, "time": 0.1}
GATES = {"time": 1.0, "repetition": 0.6, "macros": 1.5, "energy": 0.25}
RELAXATION_ORDER = ("time", "repetition", "macros", "energy")
TARGETED = ("protein_g", "carbs_g")
CEILINGS = ("fat_g", "satfat_g", "sugar_g", "sodium_mg")
NUTRIENTS = ("calories", "protein_g", "carbs_g", "fat_g", "satfat_g", "sugar_g", "sodium_mg")
CEILING_EMPHASIS = 4.0
SERVING_STEP, LEAST_SERVINGS, MOST_SERVINGS = 0.5, 0.5, 1.5
MAIN_SHARE = 0.55
LOOK_AHEAD_WEIGHT, DAY_TOLERANCE = 0.4, 1.10
SIDES, LEAST_GAP, LEAST_SIDE = 2, 80.0, 40.0


def basal_rate(weight: Column, height: Column, age: Column, male: Column) -> Column:
    """Energy at rest in kcal a day from body weight, height, age and sex."""
    return weight * 10.0 + height * 6.25 - age * 5.0 + F.when(male, F.lit(5.0)).otherwise(F.lit(-161.0))


def daily_targets(rate: Column, activity: Column, weight: Column) -> dict[str, Column]:
    """Daily energy, two quantities to reach and four ceilings."""
    energy = rate * activity
    return {
        "calories": energy, "protein_g": weight * 0.75, "carbs_g": energy * 0.50 / 4.0, "fat_g": energy * 0.35 / 9.0,
        "satfat_g": energy * 0.11 / 9.0, "sugar_g": energy * 0.05 / 4.0, "sodium_mg": F.lit(2400.0),
    }


def open_share(slot: str, open_slots: tuple[str, ...]) -> float:
    """Share of what is left of the day that one slot may take, among the open ones."""
    return SLOT_SHARE[slot] / sum(SLOT_SHARE[s] for s in open_slots)


def allowance(daily: Mapping[str, Column], consumed: Mapping[str, Column], share: float, scale: float = 1.0) -> dict[str, Column]:
    """What a slot may take of each nutrient after what the day has consumed."""
    return {n: F.greatest(daily[n] - consumed[n], F.lit(0.0)) * share * scale for n in daily}


def servings(calories: Column, target: Column) -> Column:
    """Helpings nearest the energy target in half steps, halves to even; one for an item without energy."""
    raw = F.when(calories <= 0, F.lit(1.0)).otherwise(F.try_divide(target, calories))
    return clamp(half_even(raw, SERVING_STEP), LEAST_SERVINGS, MOST_SERVINGS)


def energy_penalty(calories: Column, helpings: Column, target: Column) -> Column:
    t = F.greatest(target, F.lit(1.0))
    return F.abs(helpings * calories - t) / t


def nutrition_penalty(item: Mapping[str, Column], helpings: Column, target: Mapping[str, Column], emphasis: Column | float = CEILING_EMPHASIS) -> Column:
    """Mean deviation from the quantities to reach plus the weighted mean excess over the ceilings."""
    floor = {n: F.greatest(target[n], F.lit(1e-6)) for n in (*TARGETED, *CEILINGS)}
    off = [F.abs(helpings * item[n] - target[n]) / floor[n] for n in TARGETED]
    over = [F.greatest(helpings * item[n] - target[n], F.lit(0.0)) / floor[n] for n in CEILINGS]
    return sum(off[1:], off[0]) / float(len(off)) + (sum(over[1:], over[0]) / float(len(over))) * emphasis


def repetition_penalty(items: Column, used: Column) -> Column:
    """Share of an item's ingredients that the plan has used."""
    return F.size(F.array_intersect(items, used)).cast("double") / F.greatest(F.size(items), F.lit(1))


def time_penalty(minutes: Column, budget: Column) -> Column:
    b = F.greatest(budget.cast("double"), F.lit(1.0))
    return F.greatest(minutes.cast("double") - b, F.lit(0.0)) / b


def combine(relevance: Column, penalties: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    return relevance * weights["relevance"] - penalties["energy"] * weights["energy"] - penalties["macros"] * weights["macros"] - penalties["repetition"] * weights["repetition"] - penalties["time"] * weights["time"]


def contributions(relevance: Column, penalties: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> dict[str, Column]:
    """Signed terms whose sum is the score."""
    return {"relevance": relevance * weights["relevance"], **{n: penalties[n] * -weights[n] for n in ("energy", "macros", "repetition", "time")}}


def admissible(penalties: Mapping[str, Column], level: int = 0, gates: Mapping[str, float] = GATES) -> Column:
    """Whether every gate holds that has not been relaxed."""
    kept = F.lit(True)
    for name in RELAXATION_ORDER[level:]:
        kept = kept & (penalties[name] <= gates[name])
    return kept


def relaxed_weights(level: int, weights: Mapping[str, float] = WEIGHTS) -> dict[str, float]:
    return {n: 0.0 if n in RELAXATION_ORDER[:level] else w for n, w in weights.items()}


def relaxation_note(level: Column) -> Column:
    """Which terms were given up, in order; empty for none."""
    given = F.slice(F.array(*map(F.lit, RELAXATION_ORDER)), F.lit(1), level)
    return F.when(level > 0, F.concat(F.lit("relaxed: "), F.array_join(given, ", "))).otherwise(F.lit(""))


def scaled_relevance(score: Column, low: Column, high: Column) -> Column:
    """Score between the least and the greatest of its set; 0.5 where all are equal."""
    return F.when(high > low, F.try_divide(score - low, high - low)).otherwise(F.lit(0.5))


def look_ahead(helpings: Column, calories: Column, slot_kcal: Column, used: Column, daily: Column, needed: Column) -> Column:
    """Penalty if what the later slots need no longer fits the day's energy."""
    left = daily * DAY_TOLERANCE - used - F.greatest(helpings * calories, slot_kcal)
    return F.greatest(needed - left, F.lit(0.0)) / F.greatest(needed, F.lit(1.0)) * -LOOK_AHEAD_WEIGHT


def affordable(helpings: Column, calories: Column, slot_kcal: Column, used: Column, reserved: Column, daily: Column) -> Column:
    return used + F.greatest(helpings * calories, slot_kcal) + reserved <= daily * DAY_TOLERANCE
