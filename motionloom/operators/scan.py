"""Ordered scans of any recurrence whose steps compose: maps of blocks are joined, never a whole track walked.

A row maps the state before it to the state after it. Where the maps of a family compose into maps
of the same family, a block of rows is one map, a block of blocks too. Blocks are folded on their
own, only their maps meet, and every block then runs from its own entry state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # rows of a block, and blocks of a block of blocks

Two = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Steps:
    """The family: a row's map, a map after one more row, two maps in turn, a map applied, a row applied."""

    lift: Callable[[Column], Column]
    then: Two
    join: Two
    act: Two
    step: Two


def _sorted(order: str, value: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, value)))


def _folded(items: Column, value: str, start: Callable[[Column], Column], more: Two) -> Column:
    """One value from a non-empty array."""
    first = start(F.get(items, F.lit(0))[value])
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, lambda acc, item: more(acc, item[value]))


def _entries(items: Column, value: str, start: Column, move: Two, *, after: bool) -> Column:
    """The state before (or after) each item, from the state before the first."""
    none = F.array(start)

    def go(acc: Column, item: Column) -> Column:
        return F.concat(acc, F.array(move(F.element_at(acc, -1), item[value])))

    states = F.aggregate(items, none, go)
    return F.slice(states, 2, F.size(items)) if after else F.slice(states, 1, F.size(items))


def composed_scan(rows: DataFrame, by: Sequence[str], value: str, start: Column, steps: Steps) -> DataFrame:
    """by, frame, state: the state after each row of a group (``by``), in the order of ``frame`` from ``start``.

    A block of BLOCK frames is one array; a group of n frames has n / BLOCK^2 maps in one array
    at most. Frames of a group are distinct.
    """
    by = list(by)
    blocks = rows.groupBy(*by, F.floor(F.col("frame") / BLOCK).alias("_block")).agg(_sorted("frame", value).alias("_rows"))
    blocks = blocks.withColumn("_super", F.floor(F.col("_block") / BLOCK))
    maps = blocks.select(*by, "_super", "_block", _folded(F.col("_rows"), value, steps.lift, steps.then).alias("_map"))
    supers = maps.groupBy(*by, "_super").agg(_sorted("_block", "_map").alias("_blocks"))
    tops = supers.select(*by, "_super", _folded(F.col("_blocks"), "_map", lambda m: m, steps.join).alias("_map"))
    tracks = tops.groupBy(*by).agg(_sorted("_super", "_map").alias("_supers"))
    into = lambda items, at: F.arrays_zip(F.transform(F.col(items), lambda i: i[at]).alias(at), F.col("_states").alias("_in"))
    entered = tracks.withColumn("_states", _entries(F.col("_supers"), "_map", start, lambda s, m: steps.act(m, s), after=False))
    entered = entered.select(*by, F.explode(into("_supers", "_super")).alias("_e")).select(*by, F.col("_e._super").alias("_super"), F.col("_e._in").alias("_in"))
    placed = _join(supers, entered, [*by, "_super"])
    placed = placed.withColumn("_states", _entries(F.col("_blocks"), "_map", F.col("_in"), lambda s, m: steps.act(m, s), after=False))
    placed = placed.select(*by, "_super", F.explode(into("_blocks", "_block")).alias("_e")).select(*by, F.col("_e._block").alias("_block"), F.col("_e._in").alias("_in"))
    done = _join(blocks.drop("_super"), placed, [*by, "_block"])
    done = done.withColumn("_states", _entries(F.col("_rows"), value, F.col("_in"), steps.step, after=True))
    out = done.select(*by, F.explode(into("_rows", "frame")).alias("_e"))
    return out.select(*by, F.col("_e.frame").alias("frame"), F.col("_e._in").alias("state"))


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, null keys included."""
    renamed = right.withColumnsRenamed({c: f"_j_{c}" for c in on})
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_j_{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"_j_{c}" for c in on])


def raised(step: int) -> Steps:
    """p -> v where p < v, else p + step: below a bound a block gives one value, above it n steps more."""
    make = lambda bound, value, n: F.struct(bound.alias("bound"), value.alias("value"), n.cast("long").alias("n"))

    def then(m: Column, v: Column) -> Column:
        return make(F.greatest(m["bound"], v - m["n"] * step), F.when(m["value"] < v, v).otherwise(m["value"] + step), m["n"] + 1)

    def join(a: Column, b: Column) -> Column:
        value = F.when(a["value"] < b["bound"], b["value"]).otherwise(a["value"] + b["n"] * step)
        return make(F.greatest(a["bound"], b["bound"] - a["n"] * step), value, a["n"] + b["n"])

    return Steps(
        lift=lambda v: make(v, v, F.lit(1)), then=then, join=join,
        act=lambda m, p: F.when(p < m["bound"], m["value"]).otherwise(p + m["n"] * step),
        step=lambda p, v: F.when(p < v, v).otherwise(p + step),
    )


def nearest() -> Steps:
    """p -> the option nearest to p, the first of equals; no options leave p.

    A block knows the options of its first row that has any, and where each of them ends.
    """

    def at(options: Column, p: Column) -> Column:
        away = F.transform(options, lambda o, k: F.struct((F.pow(o["dx"] - p["dx"], 2) + F.pow(o["dy"] - p["dy"], 2)).alias("d"), k.alias("k")))
        return F.array_min(away)["k"]

    pair = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    none = lambda options: F.size(options) == 0
    go = lambda p, options: F.when(none(options), p).otherwise(F.get(options, at(options, p)))
    act = lambda m, p: F.when(none(m["first"]), p).otherwise(F.get(m["last"], at(m["first"], p)))

    def then(m: Column, options: Column) -> Column:
        return F.when(none(options), m).when(none(m["first"]), pair(options, options)).otherwise(pair(m["first"], F.transform(m["last"], lambda p: go(p, options))))

    def join(a: Column, b: Column) -> Column:
        return F.when(none(a["first"]), b).otherwise(pair(a["first"], F.transform(a["last"], lambda p: act(b, p))))

    return Steps(lift=lambda options: pair(options, options), then=then, join=join, act=act, step=go)
