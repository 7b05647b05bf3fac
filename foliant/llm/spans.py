"""Where a pattern matches in a text, in code points, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from foliant.functions.arrays import let, runs, scan

SPAN = "array<struct<start:long,end:long,value:string,before:string,after:string>>"
BEFORE, AFTER = 40, 20
#: Characters of the pieces that a text is cut into.
PIECE = 4096


def spans(text: Column, pattern: str, only_if: str | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern, as an array of ``SPAN``'s elements.

    ``before`` and ``after`` are up to ``BEFORE`` and ``AFTER`` characters between the match
    and its neighbours. ``only_if``: a cheaper pattern that every text with a match has.
    A pattern must not match nothing. Null text: no spans.
    """
    none = F.array().cast(SPAN)

    def placed(x: Column) -> Column:
        values, pieces = x["values"], x["pieces"]
        lengths = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, v: F.struct(F.length(p).cast("long").alias("gap"), F.length(v).cast("long").alias("own")))
        starts = scan(lengths, F.lit(0).cast("long"), lambda at, n: (at + n["gap"] + n["own"], at + n["gap"]), "long")
        beside = F.zip_with(
            F.slice(pieces, 1, F.size(values)), F.slice(pieces, 2, F.size(values)),
            lambda p, n: F.struct(F.right(p, F.lit(BEFORE)).alias("before"), F.left(n, F.lit(AFTER)).alias("after")),
        )
        found = F.zip_with(starts, values, lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))
        return F.zip_with(found, beside, lambda f, b: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["value"].alias("value"), b["before"].alias("before"), b["after"].alias("after")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("pieces"))
    return F.coalesce(F.when(text.rlike(only_if or pattern), let(both, placed)), none)


def greedy(items: Column, kind: str, best: Callable[[Column], Column], given: Callable[[Column], Column]) -> Column:
    """Of ``items`` (structs with ``start`` and ``end``, type ``kind``) those that stay: in order of ``best``, what overlaps nothing that stays already.

    Items that are ``given`` always stay. The result is in order of start. Items are cut into runs of
    overlapping ones first, so that only those of a run are compared.
    """
    by_start = lambda x: F.transform(F.array_sort(F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("item")))), lambda k: k["item"])

    def chosen(part: Column) -> Column:
        ordered = F.transform(F.array_sort(F.transform(part, lambda s: F.struct(best(s).alias("key"), s["start"].alias("start"), s["end"].alias("end"), s.alias("item")))), lambda k: k["item"])
        stays = lambda kept, s: given(s) | ~F.exists(kept, lambda k: (k["end"] > s["start"]) & (s["end"] > k["start"]))
        kept = F.aggregate(ordered, F.array().cast(f"array<{kind}>"), lambda kept, s: F.when(stays(kept, s), F.array_append(kept, s)).otherwise(kept))
        return F.when(F.size(part) == 1, part).otherwise(by_start(kept))

    whole = lambda x: F.flatten(F.transform(runs(x), chosen))
    return let(by_start(items), lambda x: F.when(F.size(x) > 1, whole(x)).otherwise(x))


def pieces_of(text: Column) -> Column:
    """``text`` cut into pieces of ``PIECE`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(pieces: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` (from 0, exclusive) of a text cut by ``pieces_of``; finding them does not grow with the text."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")

    def of(k: Column) -> Column:
        at = F.greatest(start - k * PIECE, F.lit(0)).cast("int")
        return F.substr(pieces[k], at + 1, (F.least(end - k * PIECE, F.lit(PIECE)) - at).cast("int"))

    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), of), "")).otherwise("")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` (one at least) pass the Luhn test."""
    turned = F.reverse(digits(value))
    doubled = F.translate(F.regexp_replace(turned, "(.)(.)?", "$2"), "0123456789", "0246813579")

    def total(x: Column) -> Column:
        one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.coalesce(F.try_to_number(F.substr(x, i, F.lit(1)), F.lit("9")), F.lit(0)).cast("int"))
        return F.aggregate(one, F.lit(0), lambda a, d: a + d)

    return (total(F.regexp_replace(turned, "(.)(.)?", "$1")) + total(doubled)) % 10 == 0


def matches(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), 1.0).otherwise(0.0)


def share(value: Column, pattern: str) -> Column:
    """Share of the characters of ``value`` that match a pattern of one character or more."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))
