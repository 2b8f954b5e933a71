"""Guards, intents, transitions and streaks over turns, as ordered CASE expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import compact, digit_runs


def ordered_case(rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def guard(text: Column, triggers: list[tuple[str, list[str]]], has_pii: Column | None = None) -> Column:
    """The first category with a trigger in the squashed text, then personal data, then long digit runs, else "ok"."""
    squashed = compact(text, r"\s.,!?~")
    rules = [(name, F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(squashed, w))) for name, words in triggers]
    if has_pii is not None:
        rules.append(("pii", has_pii))
    return ordered_case([*rules, ("digits", digit_runs(text) > 0)], "ok")


def intent(text: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The first intent whose pattern the compacted text has."""
    plain = compact(text, r"\s.,!?")
    return ordered_case([(name, plain.rlike(pattern)) for name, pattern in rules], default)


def violations(events: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """State changes that are not among ``allowed`` (src, dst)."""
    src = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    steps = events.select(key, *order, src.alias("src"), F.col(state).alias("dst")).where("src is not null")
    return steps.join(allowed, ["src", "dst"], "left_anti")


def streaks(events: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """Longest run of consecutive hits of each key; any other event resets the count."""
    by = Window.partitionBy(key).orderBy(*order)
    island = events.withColumn("_hit", hit.cast("int")).withColumn("_island", F.sum(1 - F.col("_hit")).over(by))
    return island.groupBy(key, "_island").agg(F.sum("_hit").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def next_pending(order: Column, pending: Column, current: Column) -> Column:
    """The first pending id after the current one in ``order``, else the first from the start, else null."""
    at = F.array_position(order, current)
    waiting = F.filter(order, lambda x: F.array_contains(pending, x))
    later = F.filter(waiting, lambda x: F.array_position(order, x) > at)
    return F.coalesce(F.try_element_at(later, F.lit(1)), F.try_element_at(waiting, F.lit(1)))
