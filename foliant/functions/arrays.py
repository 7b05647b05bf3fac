"""Folds over arrays in the JVM whose work grows with the items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements that a scan appends to one array; such arrays are joined at the end.
BLOCK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(state, item)``, which returns the next state and an element of type ``kind``, makes of each item in turn.

    Appending copies an array, so elements are gathered in blocks: the work grows with the
    items and not with their square.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(done: Column, x: Column) -> Column:
        after, element = step(done["state"], x)
        return F.struct(after.alias("state"), F.array_append(done["out"], element).alias("out"))

    def block(done: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(done["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(done["out"], r["out"]).alias("out")))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))

    zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    whole = lambda x: F.flatten(F.aggregate(blocks(x), zero, block, lambda done: done["out"]))
    return let(items, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def runs(items: Column, touching: bool = False) -> Column:
    """``items(start, end)``, in order of start and one at least, as an array of runs: one begins where all before have ended.

    ``touching``: what begins just where all before end goes on with their run.
    """
    begins = lambda at, s: (s["start"] > at) if touching else (s["start"] >= at)

    def cut(x: Column) -> Column:
        fresh = scan(x, F.lit(-1).cast("long"), lambda at, s: (F.greatest(at, s["end"].cast("long")), begins(at, s)), "boolean")
        first = let(fresh, lambda n: F.filter(F.sequence(F.lit(1), F.size(n)), lambda i: (i == 1) | n[i - 1]))
        after = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.array(F.size(x) + 1))
        return let(first, lambda c: F.zip_with(c, after(c), lambda a, b: F.slice(x, a, b - a)))

    return let(items, cut)
