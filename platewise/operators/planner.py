"""Weekly plans for a block of profiles: greedy slots with look-ahead, sides and staged relaxation.

Planning is sequential in days and slots but not in profiles: each step scores the
whole pool for every profile of the block in one job, whose partial maxima are
combined before any row moves.  Between steps only the choices, one row per
profile, and the running totals kept from them live on the driver; their size is
that of the block times the slots of a week.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import nutrition as N
from platewise.operators.content import top_k

SLOTS = tuple(N.SLOT_SHARE)
DAYS = 7
BLOCK = 1000
TOP = 50


@dataclass
class State:
    """One profile's plan so far."""

    profile: dict
    daily: dict[str, float]
    rows: list[dict] = field(default_factory=list)
    rejected: set[int] = field(default_factory=set)

    def eaten(self, day: int, without: str | None = None) -> dict[str, float]:
        mine = [r for r in self.rows if r["day"] == day and r["slot"] != without]
        return {n: float(sum(r["servings"] * r[n] for r in mine)) for n in N.NUTRIENTS}

    def filled(self, day: int) -> set[str]:
        return {r["slot"] for r in self.rows if r["day"] == day}

    def capped(self, side: bool, most: int) -> list[int]:
        """Ids that may not be chosen again."""
        count: dict[int, int] = {}
        for r in self.rows:
            count[r["id"]] = count.get(r["id"], 0) + 1
        return sorted(self.rejected | {i for i, n in count.items() if side or n >= most})

    def used(self) -> list[str]:
        return sorted({i for r in self.rows for i in r["ingr"]})


def daily_targets(p: dict) -> dict[str, float]:
    """Daily targets of one profile on the driver."""
    rate = p["weight_kg"] * 10 + p["height_cm"] * 6.25 - p["age"] * 5 + (5 if p["male"] else -161)
    e = rate * p["activity"]
    return {"calories": e, "protein_g": p["weight_kg"] * 0.75, "carbs_g": e * 0.5 / 4, "fat_g": e * 0.35 / 9, "satfat_g": e * 0.11 / 9, "sugar_g": e * 0.05 / 4, "sodium_mg": 2400.0}


_NUMBERS = [*(f"t_{n}" for n in N.NUTRIENTS), "kcal_used", "kcal_day", "kcal_needed", "spare_sodium", "spare_sugar", "budget"]
_STATE = pa.schema([("profile_id", pa.int32()), *((n, pa.float64()) for n in _NUMBERS), ("capped", pa.list_(pa.int64())), ("used", pa.list_(pa.string()))])


def _frame(pool: DataFrame, rows: list[tuple]) -> DataFrame:
    """The pool with each profile's totals, less what the profile may not repeat."""
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _STATE, strict=True)]
    state = pool.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=_STATE))
    # one row per profile of the block
    return pool.join(F.broadcast(state), "profile_id").where(~F.array_contains("capped", F.col("id")))


def _scored(rows: DataFrame, scale: float) -> DataFrame:
    """Helpings for ``scale`` of the slot's allowance and the penalties against it."""
    t = {n: F.col(f"t_{n}") * scale for n in N.NUTRIENTS}
    rows = rows.withColumn("helpings", N.servings(F.col("calories"), t["calories"]))
    return rows.withColumns({
        "energy": N.energy_penalty(F.col("calories"), F.col("helpings"), t["calories"]),
        "macros": N.nutrition_penalty({n: F.col(n) for n in N.NUTRIENTS}, F.col("helpings"), t),
        "repetition": N.repetition_penalty(F.col("ingr"), F.col("used")),
        "time": N.time_penalty(F.col("minutes"), F.col("budget")),
    })


def _within_limits(helpings: Column) -> Column:
    sodium = F.col("spare_sodium").isNull() | (helpings * F.col("sodium_mg") <= F.col("spare_sodium"))
    sugar = F.col("spare_sugar").isNull() | (helpings * F.col("sugar_g") <= F.col("spare_sugar"))
    return sodium & sugar


def _penalties() -> dict[str, Column]:
    return {n: F.col(n) for n in ("energy", "macros", "repetition", "time")}


_PICK = ["id", "helpings", *N.NUTRIENTS, "minutes", "ingr", "score"]


def _best(rows: DataFrame) -> list:
    best = rows.groupBy("profile_id").agg(F.max_by(F.struct(*_PICK), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("profile_id", "b.*").collect()  # one row per profile of the block


def choose_mains(pool: DataFrame, slot: str, rows: list[tuple], level: int = 0) -> list:
    """The best main of each profile: limits as if it filled the slot, gates, scaled relevance, look-ahead."""
    found = _frame(pool.where(F.col(f"in_{slot}") & ~F.col("is_side")), rows)
    found = found.where(_within_limits(N.servings(F.col("calories"), F.col("t_calories"))))
    found = _scored(found, N.MAIN_SHARE).where(N.admissible(_penalties(), level))
    ends = found.groupBy("profile_id").agg(F.min("relevance").alias("low"), F.max("relevance").alias("high"))
    found = found.join(F.broadcast(ends), "profile_id")  # one row per profile
    relevance = N.scaled_relevance(F.col("relevance"), F.col("low"), F.col("high"))
    found = found.withColumn("score", N.combine(relevance, _penalties(), N.relaxed_weights(level)))
    found = top_k(found, "profile_id", [F.desc("score"), F.col("id")], TOP)
    ahead = N.look_ahead(F.col("helpings"), F.col("calories"), F.col("t_calories"), F.col("kcal_used"), F.col("kcal_day"), F.col("kcal_needed"))
    return _best(found.withColumn("score", F.col("score") + ahead))


def choose_sides(pool: DataFrame, slot: str, rows: list[tuple]) -> list:
    """The best side of each profile for the gap in ``t_calories``: relevance at 0.4, all weights, no gates."""
    sides = pool.where(F.col("is_side") & (F.col("side_breakfast") if slot == "breakfast" else F.lit(True)))
    found = _scored(_frame(sides, rows), 1.0).where(_within_limits(F.col("helpings")))
    kcal = F.col("helpings") * F.col("calories")
    found = found.where((kcal >= N.LEAST_SIDE) & (F.abs(F.col("t_calories") - kcal) < F.col("t_calories")))
    return _best(found.withColumn("score", N.combine(F.col("relevance") * 0.4, _penalties())))


class Planner:
    """Plans of one block of profiles over a pool ``(profile_id, id, relevance, ingr, in_<slot>, is_side, ...)``."""

    def __init__(self, pool: DataFrame, profiles: list[dict], most_repeats: int = 2, locked: list[dict] = ()):
        """``locked`` are rows of an earlier :meth:`plan`: their slots are kept and count as eaten and used."""
        if len(profiles) > BLOCK:
            raise ValueError(f"plan blocks of at most {BLOCK} profiles")
        self.pool, self.most = pool, most_repeats
        self.states = {p["profile_id"]: State(p, daily_targets(p)) for p in profiles}
        for r in locked:
            self.states[r["profile_id"]].rows.append(dict(r))

    def _row(self, s: State, day: int, slot: str, side: bool = False) -> tuple | None:
        eaten = s.eaten(day, None if side else slot)
        budget = float(s.profile["weekend_minutes"] if day >= 5 else s.profile["weekday_minutes"])
        open_ = tuple(x for x in SLOTS if x not in s.filled(day) or x == slot)
        if side:
            plate = {n: float(sum(r["servings"] * r[n] for r in s.rows if r["day"] == day and r["slot"] == slot)) for n in N.NUTRIENTS}
            before = s.eaten(day, slot)
            share = N.open_share(slot, open_)
            target = {n: max(max(s.daily[n] - before[n], 0.0) * share - plate[n], 0.0) for n in N.NUTRIENTS}
            if target["calories"] < N.LEAST_GAP:
                return None
        else:
            plate = dict.fromkeys(N.NUTRIENTS, 0.0)
            target = {n: max(s.daily[n] - eaten[n], 0.0) * N.open_share(slot, open_) for n in N.NUTRIENTS}
        later = [x for x in SLOTS[SLOTS.index(slot) + 1 :] if x not in s.filled(day)]
        needed = s.daily["calories"] * float(sum(N.SLOT_SHARE[x] for x in later))
        spare = {n: None if s.profile.get(m) is None else s.profile[m] - plate[c] for n, m, c in (("sodium", "max_sodium", "sodium_mg"), ("sugar", "max_sugar", "sugar_g"))}
        return (
            s.profile["profile_id"], *(target[n] for n in N.NUTRIENTS), eaten["calories"], s.daily["calories"], needed, spare["sodium"], spare["sugar"],
            budget, s.capped(side, self.most), s.used(),
        )

    def _place(self, picks: list, day: int, slot: str, role: str, pos: int, level: int) -> set[int]:
        for r in picks:
            d = r.asDict()
            d |= {"day": day, "slot": slot, "role": role, "pos": pos, "servings": d["helpings"], "level": level}
            self.states[r["profile_id"]].rows.append(d)
        return {r["profile_id"] for r in picks}

    def fill(self, day: int, slot: str, level: int = 0, only: set[int] | None = None) -> set[int]:
        """Fill one slot for all profiles or ``only`` some; the profiles that got a main."""
        asked = [s for k, s in self.states.items() if (only is None or k in only) and slot not in s.filled(day)]
        if not asked:
            return set()
        done = self._place(choose_mains(self.pool, slot, [self._row(s, day, slot) for s in asked], level), day, slot, "main", 0, level)
        going = done
        for pos in range(1, N.SIDES + 1):
            rows = [r for r in (self._row(self.states[k], day, slot, side=True) for k in sorted(going)) if r]
            if not rows:
                break
            going = self._place(choose_sides(self.pool, slot, rows), day, slot, "side", pos, level)
        return done

    def replace(self, day: int, slot: str) -> set[int]:
        """Reject each profile's main of a slot for good and fill the slot again, the rest of the plan as it is.

        The candidates are scored anew against what the rest leaves; the sides are chosen
        anew too.  A profile without a main there is left alone.
        """
        asked: dict[int, set[int]] = {}
        for k, s in self.states.items():
            mains = [r for r in s.rows if (r["day"], r["slot"], r["role"]) == (day, slot, "main")]
            if mains:
                s.rejected |= {r["id"] for r in mains}
                s.rows = [r for r in s.rows if (r["day"], r["slot"]) != (day, slot)]
                asked.setdefault(mains[0]["level"], set()).add(k)
        done: set[int] = set()
        for level, keys in sorted(asked.items()):
            done |= self.fill(day, slot, level, keys)
        return done

    def week(self, days: int = DAYS) -> list[dict]:
        """All slots in order, then the unfilled ones at rising levels of relaxation."""
        missing: list[tuple[int, str, set[int]]] = []
        for day in range(days):
            for slot in SLOTS:
                left = {k for k, s in self.states.items() if slot not in s.filled(day)}
                left -= self.fill(day, slot)
                if left:
                    missing.append((day, slot, left))
        for day, slot, left in missing:
            for level in range(1, len(N.RELAXATION_ORDER) + 1):
                left = left - self.fill(day, slot, level, left)
                if not left:
                    break
        return self.plan()

    def plan(self) -> list[dict]:
        return [r for s in self.states.values() for r in s.rows]


PLAN_DDL = "profile_id int, day int, slot string, role string, pos int, id long, servings double, level int, " + ", ".join(f"{n} double" for n in N.NUTRIENTS) + ", minutes long, ingr array<string>"


def as_table(spark, rows: list[dict]) -> DataFrame:
    """The plan as a table, one row per dish."""
    names = [c.split()[0] for c in PLAN_DDL.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PLAN_DDL)


def plates(plan: DataFrame) -> DataFrame:
    """Totals of each plate (profile, day, slot) over its dishes as served."""
    return plan.groupBy("profile_id", "day", "slot").agg(F.count("*").alias("dishes"), *(F.sum(F.col("servings") * F.col(n)).alias(n) for n in N.NUTRIENTS), F.sum("minutes").alias("minutes"))


def days(plan: DataFrame) -> DataFrame:
    """Totals of each day, saturated fat included."""
    return plan.groupBy("profile_id", "day").agg(*(F.sum(F.col("servings") * F.col(n)).alias(n) for n in N.NUTRIENTS))
