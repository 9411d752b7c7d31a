"""Fusing sources: prioritised heights with provenance, rule tables, repairs, landmark caps, floors. Pure column expressions,
so a whole chain of steps is one projection."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """All conditions that are given must hold; `action` is drop, keep, exact or roof."""

    action: str = "keep"
    label: str | None = None
    source: str | None = None
    field: str | None = None
    values: tuple[str, ...] = ()
    prefix: tuple[str, ...] = ()
    limits: dict = dataclasses.field(default_factory=dict)  # h_below, h_from, area_below, area_from

    def holds(self, h: Column, area: Column, source: Column) -> Column:
        out = F.lit(True)
        if self.source is not None:
            out &= F.coalesce(source == self.source, F.lit(False))
        if self.field is not None:
            v = F.coalesce(F.col(self.field).cast("string"), F.lit(""))
            if self.values:
                out &= F.lower(v).isin([x.lower() for x in self.values])
            if self.prefix:
                out &= F.greatest(*[v.startswith(x) for x in self.prefix]) if len(self.prefix) > 1 else v.startswith(self.prefix[0])
        known = F.coalesce(h, F.lit(0))
        for name, limit in self.limits.items():
            value = known if name.startswith("h_") else area
            out &= value < limit if name.endswith("_below") else value >= limit
        return out


def ruled(df: DataFrame, rules: list[Rule], h: str = "h", area: str = "area", source: str = "src") -> DataFrame:
    """df with the first rule that holds (number, or null), its label, and what its action says."""
    chain = None
    for i, r in enumerate(rules):
        test = r.holds(F.col(h), F.col(area), F.col(source))
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    number = chain if chain is not None else F.lit(None).cast("int")
    labels = F.array(*[F.lit(r.label or r.action) for r in rules]) if rules else F.array(F.lit(None).cast("string"))
    actions = F.array(*[F.lit(r.action) for r in rules]) if rules else F.array(F.lit(None).cast("string"))
    df = df.withColumn("rule_no", number).withColumn("rule", F.get(labels, F.col("rule_no"))).withColumn("_action", F.get(actions, F.col("rule_no")))
    is_in = lambda *x: F.coalesce(F.col("_action").isin(*x), F.lit(False))
    return df.withColumns({"dropped": is_in("drop"), "keep_small": is_in("keep", "exact", "roof"), "h_exact": is_in("exact", "roof")}).drop("_action")


def rule_counts(ruled_rows: DataFrame, area: str = "area") -> DataFrame:
    return ruled_rows.where("rule_no is not null").groupBy("rule_no", "rule").agg(F.count("*").alias("n"), F.sum(area).alias("area"))


def prioritised(sources: list[tuple[str, Column]], default: Column | None = None) -> tuple[Column, Column]:
    """(value, name) of the first source that has a value."""
    value = F.coalesce(*[v for _, v in sources], *([default] if default is not None else []))
    name = None
    for label, v in sources:
        name = F.when(v.isNotNull(), label) if name is None else name.when(v.isNotNull(), label)
    return value, name.otherwise(F.lit("default")) if default is not None else name


def blended(a: Column, b: Column, weights: tuple[float, float], band: tuple[float, float]) -> Column:
    """A weighted mean where both are known and their plain mean lies in the band, ends included; else null."""
    return F.when(((a + b) / 2).between(*band), weights[0] * a + weights[1] * b)


def despiked(h: Column, mean: Column, listed: Column, over: float, ratio: float) -> tuple[Column, Column]:
    """(height, mark): a top far over the listed height whose mean is low falls to the listed height; else one with no listing
    that is far over its mean falls to the mean times a margin. Falls under 1 m don't count."""
    by_listing = F.when((h > F.greatest(listed + over, listed * ratio)) & (mean < listed + over), listed)
    by_mean = F.when(listed.isNull() & (h > ratio * 2 * mean), mean * ratio)
    new = F.least(h, F.coalesce(by_listing, by_mean))
    falls = F.coalesce(new < h - 1, F.lit(False))
    return F.when(falls, new).otherwise(h), F.when(falls & by_listing.isNotNull(), "osm").when(falls, "mean")


def reconciled(h: Column, opinions: list[Column], floors: Column, over: float = 10, share: float = 0.3) -> Column:
    """Second opinions in turn, each seeing the ones before: a much higher one lifts, unless the storeys speak against it."""
    for v in opinions:
        up = (v > h + F.greatest(F.lit(over), share * h)) & F.coalesce(v <= 4.5 * floors + 15, F.lit(True))
        h = F.when(F.coalesce(up, F.lit(False)), v).otherwise(h)
    return h


def finished(h: Column, area: Column, exact: Column, least: float, small: float = 50) -> Column:
    """Small footprints and those under the least height get it, exact ones stay; one decimal, halves to even."""
    raised = F.when(area < small, F.greatest(F.coalesce(h, F.lit(least)), F.lit(least))).otherwise(F.greatest(h, F.lit(least)))
    return F.bround(F.when(exact, h).otherwise(raised), 1)


def floors(h: Column, storey: float) -> Column:
    return F.greatest(F.bround(h / storey).cast("int"), F.lit(1))
