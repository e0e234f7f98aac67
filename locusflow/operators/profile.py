"""Profiles: evidence confirmed by choices, inferred defaults, and the state machine for streams."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, DOMINANCE = 3, 0.6
DEFAULT_KM = 1.0


def dominant(rows: DataFrame, key: str, value: str, *, least: int = LEAST, share: float = DOMINANCE) -> DataFrame:
    """(key, value, n, of): the commonest value where there is enough evidence and it dominates, else null."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.sum("n").alias("of"), F.min_by(F.struct("n", value), F.struct(-F.col("n"), F.col(value))).alias("_t"))
    sure = (F.col("of") >= least) & (F.col("_t.n") / F.col("of") >= share)
    return top.select(key, F.when(sure, F.col(f"_t.{value}")).alias(value), F.col("_t.n").alias("n"), "of")


def usual_distance(rows: DataFrame, key: str, value: str, least: int = LEAST) -> DataFrame:
    """(key, value): the median of confirmed distances, null below `least` of them."""
    return rows.groupBy(key).agg(F.when(F.count(value) >= least, F.median(value)).alias(value))


def confirmed(turns: DataFrame, *, actor: str = "actor", order: list[str], chosen: Column) -> DataFrame:
    """The last stated intent before each choice: later ones in a turn replace earlier ones.

    A segment ends with a choice; its last row that isn't one is the confirmed intent.
    """
    past = Window.partitionBy(actor).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = turns.withColumn("_chosen", chosen).withColumn("segment", F.coalesce(F.sum(F.when(chosen, 1).otherwise(0)).over(past), F.lit(0)))
    closed = cut.groupBy(actor, "segment").agg(F.bool_or("_chosen").alias("_closed"))
    last = cut.where(~F.col("_chosen")).withColumn("_n", F.row_number().over(Window.partitionBy(actor, "segment").orderBy(*(F.desc(o) for o in order)))).where("_n = 1")
    return last.join(closed.where("_closed"), [actor, "segment"]).drop("_n", "_chosen", "_closed")


Seen = dict[str, int]  # observed value -> times, in order of first sight


def middle(seen: Seen) -> str | None:
    """The median of observed numbers."""
    values = sorted(float(v) for v, n in seen.items() for _ in range(n))
    return str(median(values)) if len(values) >= LEAST else None


def prevailing(seen: Seen) -> str | None:
    """The value that makes up the required share of enough observations."""
    of = sum(seen.values())
    return next((v for v, n in seen.items() if of >= LEAST and n >= DOMINANCE * of), None)


#: How a trait's value follows from its evidence; traits not named here go by `prevailing`.
INFERRED = {"max_distance_km": middle}
#: What a turn may state, and the trait that it is evidence of; `after` stands for the last chosen category.
STATED = {"local": "local", "max_distance_km": "max_distance_km", "next_category": "after"}
TASTED = ("meal", "bar")


@dataclass
class Profile:
    """A user's state as a table of evidence, trait -> observed values; pure steps, used alike by batches and streams."""

    evidence: dict[str, Seen] = field(default_factory=dict)
    said: dict[str, str] = field(default_factory=dict)
    open: dict[str, str] = field(default_factory=dict)  # trait -> value stated since the last choice
    after: str | None = None
    turn: int = 0
    visited: list[str] = field(default_factory=list)

    def trait(self, stated: str) -> str | None:
        """The trait that a stated field is evidence of; null where it takes an earlier choice and there is none."""
        name = STATED[stated]
        return name if name != "after" else self.after and f"after_{self.after}"

    def value(self, trait: str | None) -> str | None:
        """Said outright, else inferred, else null."""
        if trait is None:
            return None
        return self.said.get(trait) or INFERRED.get(trait, prevailing)(self.evidence.get(trait, {}))

    def observe(self, trait: str, value: str) -> None:
        word = str(value) if trait in INFERRED else str(value).lower()
        seen = self.evidence.setdefault(trait, {})
        seen[word] = seen.get(word, 0) + 1

    def say(self, trait: str, value: str) -> None:
        """A lasting preference: it holds at once, and counts as evidence except where evidence is measured."""
        self.said[trait] = value
        if trait not in INFERRED:
            self.observe(trait, value)

    def intend(self, turn: dict[str, str]) -> dict[str, str]:
        """The turn with what it leaves open filled from the profile. What it states waits for a choice; a later turn replaces it."""
        traits = {stated: self.trait(stated) for stated in STATED}
        self.open = {traits[stated]: turn[stated] for stated in STATED if stated in turn and traits[stated]}
        known = {stated: v for stated, trait in traits.items() if (v := self.value(trait)) is not None}
        return {"max_distance_km": str(DEFAULT_KM)} | known | turn

    def choose(self, item: str, category: str, sub: str) -> None:
        """A choice confirms what is open and ends the turn."""
        confirmed, self.open = dict(self.open), {}
        if category in TASTED:
            confirmed["cuisine"] = sub
        for trait, value in confirmed.items():
            self.observe(trait, value)
        self.turn, self.after = self.turn + 1, category
        self.visited.append(item)

    def summary(self) -> dict[str, str]:
        """A line per lasting trait: its value and where it is from, or how much evidence there is."""
        out = {}
        for trait in ("local", "max_distance_km", "cuisine"):
            value, n = self.value(trait), sum(self.evidence.get(trait, {}).values())
            out[trait] = f"{value} ({'said' if trait in self.said else 'inferred'})" if value is not None else f"open ({n}/{LEAST})"
        return out

    def dump(self) -> dict:
        return asdict(self)

    @staticmethod
    def load(state: dict) -> Profile:
        return Profile(**state)


def step(profile: Profile, event: dict) -> None:
    """Applies one log event: kind is say, intend or choose."""
    if event["kind"] == "say":
        profile.say(event["trait"], event["value"])
    elif event["kind"] == "intend":
        profile.intend({k: event[k] for k in STATED if event.get(k) is not None})
    elif event["kind"] == "choose":
        profile.choose(event["item"], event["category"], event["sub"])
