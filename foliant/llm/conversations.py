"""Conversation structure: faults of turns, and the cheapest edits that repair it.

A whole conversation is ``(system? (user assistant)+)?``. Faults come from windows and counts;
the edits from a fold over the sorted turns in the JVM: ``aggregate`` carries, for each of four
states (nothing kept yet, after a system turn, after a user, after an assistant), the least
``(cost, audit)``, and every step takes the ``least`` of native structs. No two audits of equal cost
that end in one state are the beginning of one another, so the least of the longer ones has the least
beginning: the fold may be cut anywhere.

So it is: turns are sorted once over all tasks, numbered in that order and written; each block of
at most ``BLOCK`` turns of a conversation is folded from all four states, and blocks of one
conversation are joined like products of matrices, ``FAN`` at a time. However long a conversation
is, no task holds more of it than a block of narrow facts or the audits of ``FAN`` blocks. Texts
are not part of the fold; the edits meet them by a turn's number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from foliant.functions.arrays import let, scan
from foliant.llm.storage import written

#: Bits of a turn's number within its block, and of a block's among those that are joined at a time.
BLOCK_BITS, FAN_BITS = 8, 6
#: White space, and the signs that end a turn.
WHITE, END = r"\x20\x09-\x0D", ".!?"
STATES = ("nothing", "system", "user", "assistant")
#: Costs of edits; what stays truncated costs more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
PATH = "struct<cost:long,audit:string>"
FRONT = "struct<" + ",".join(f"{s}:{PATH}" for s in STATES) + ">"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, pos`` of ``turns``, written once: ``pos`` rises with conversation, turn (nulls first), role, text.

    Rows whose role or text is null have one space there. One conversation's rows have neighbouring numbers
    within a part, so a third of all rows under one id is spread over parts like the rest.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), value(role).alias("role"), value(text).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.drop("row").withColumn("pos", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, initial, blank, duplicate, truncated`` of ``numbered`` turns: each turn's first fault alone.

    Blank: nothing but white space. Duplicate: role and text of an earlier turn (compared by SHA-256).
    Truncated: the last sign is none of ``.!?``.
    """
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    cut = ~F.col("text").rlike(rf"[{END}][{WHITE}]*\z")
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = turns.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), F.when(~blank, said).alias("said"))
    first = rows.where("said is not null").groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")  # most turns are said once
    first = first.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    again = ~F.col("blank") & F.coalesce(F.col("first") < F.col("pos"), F.lit(False))
    return joined.select("conv_id", "pos", "turn", "initial", "blank", again.alias("duplicate"), (~F.col("blank") & ~again & F.col("cut")).alias("truncated"))


def _plus(path: Column, cost: Column | int, letter: str) -> Column:
    return F.when(path.isNotNull(), F.struct((path["cost"] + cost).cast("long").alias("cost"), F.concat(path["audit"], F.lit(letter)).alias("audit")))


def _front(*paths: Column) -> Column:
    return F.struct(*(p.alias(s) for p, s in zip(paths, STATES)))


def _inserted(front: Column, use) -> Column:
    """``use`` of a front to which a user turn, an assistant turn or both were added."""
    nothing, system, user, assistant = (front[s] for s in STATES)
    asked = F.least(user, _plus(F.least(nothing, system, assistant), INSERT, "I"))
    return let(asked, lambda u: let(_front(nothing, system, u, F.least(assistant, _plus(u, INSERT, "I"))), use))


def _step(front: Column, turn: Column) -> Column:
    """The front after one turn was kept, given another role or deleted."""
    may, more = ~(turn["blank"] | turn["duplicate"]), F.when(turn["truncated"], TRUNCATED).otherwise(0)

    def taken(path: Column, initial: str) -> Column:
        return F.when(may, F.when(turn["initial"] == initial, _plus(path, more, "K")).otherwise(_plus(path, more + REROLE, "R")))

    def moved(f: Column) -> Column:
        nothing, system, user, assistant = (f[s] for s in STATES)
        gone = [_plus(x, DELETE, "D") for x in (nothing, system, user, assistant)]
        first = F.when(may & (turn["initial"] == "s"), _plus(nothing, more, "K"))
        asked = taken(F.least(nothing, system, assistant), "u")
        return _front(gone[0], F.least(gone[1], first), F.least(gone[2], asked), F.least(gone[3], taken(user, "a")))

    return _inserted(front, moved)


def _start(state: str) -> Column:
    return _front(*(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")) if s == state else F.lit(None).cast(PATH) for s in STATES)).cast(FRONT)


def _after(front: Column, block: Column) -> Column:
    """The front after a block whose fronts from each state are known."""

    def by(start: str, end: str) -> Column:
        a, b = front[start], block[start][end]
        return F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit")))

    return _front(*(F.least(*(by(start, end) for start in STATES)) for end in STATES))


def _pairs(before: Column, after: Column) -> Column:
    """1 if two neighbouring initials may not follow each other."""
    return F.when(F.concat(before, after).isin("su", "ua", "au"), 0).otherwise(1)


def _folded(facts: DataFrame) -> DataFrame:
    """``conv_id, block, fronts, head, tail, illegal`` of each block of turns: fronts from every state."""
    key = F.shiftright("pos", BLOCK_BITS)
    turns = F.array_sort(F.collect_list(F.struct("pos", "initial", "blank", "duplicate", "truncated")))
    rows = facts.groupBy("conv_id", key.alias("block")).agg(turns.alias("turns"))
    fronts = F.struct(*(F.aggregate("turns", _start(s), lambda f, t: _step(f, t).cast(FRONT)).alias(s) for s in STATES))
    t = F.col("turns")
    bad = F.aggregate(F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: _pairs(a["initial"], b["initial"])), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("conv_id", "block", fronts.alias("fronts"), t[0]["initial"].alias("head"), F.element_at(t, -1)["initial"].alias("tail"), bad.alias("illegal"))


def _joined(blocks: DataFrame, key: Column) -> DataFrame:
    """``blocks`` of one ``key`` of a conversation as one block."""
    rows = blocks.groupBy("conv_id", key.alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "fronts", "head", "tail", "illegal"))).alias("b"))
    b = F.col("b")
    rest = F.slice(b, 2, F.size(b))
    fronts = F.struct(*(F.aggregate(rest, b[0]["fronts"][s], lambda f, x: _after(f, x["fronts"]).cast(FRONT)).alias(s) for s in STATES))
    seams = F.zip_with(F.slice(b, 1, F.size(b) - 1), rest, lambda x, y: _pairs(x["tail"], y["head"]))
    illegal = F.aggregate(F.concat(F.transform(b, lambda x: x["illegal"]), seams), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("conv_id", "block", fronts.alias("fronts"), b[0]["head"].alias("head"), F.element_at(b, -1)["tail"].alias("tail"), illegal.alias("illegal"))


def plans(facts: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of each conversation of ``faults``.

    Audit: the initials of the cheapest edits in order (keep, rerole, delete, insert), the ASCII-least
    of equally cheap ones. Illegal: neighbours whose roles' initials are none of su, ua, au. A role is judged by
    its initial; an empty one has none and is never legal.
    """
    blocks = written(_folded(facts), "turn-blocks")
    most = lambda: blocks.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    shift = 0
    while most() > 1 << FAN_BITS:
        shift += FAN_BITS
        blocks = written(_joined(blocks, F.shiftright("block", FAN_BITS)), "turn-blocks")
    whole = _joined(blocks, F.lit(0))
    best = _inserted(F.col("fronts.nothing"), lambda f: F.least(f["nothing"], f["assistant"]))
    return whole.withColumn("best", best).select("conv_id", "illegal", "best.cost", "best.audit")


def summaries(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row for each conversation of ``faults``.

    Gaps: turn numbers that are missing between the least and the greatest; null ones do not count.
    """
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    wide = (F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")).try_cast("long")
    facts = facts.groupBy("conv_id").agg(F.coalesce(wide, F.lit(0)).cast("long").alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    return facts.join(plan.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def repaired(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, nth, part, role, text``: the turns of every repaired conversation in the order of ``nth, part``; inserted ones have empty texts.

    ``turns`` are ``numbered``, ``plan`` is that of their faults. A conversation that keeps no
    turn has no row. Texts are exchanged once, by the number of their turn.
    """
    part = F.shiftright("pos", 33)
    begins = turns.groupBy("conv_id", part.alias("part")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part that holds turns of it
    begins = begins.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    places = turns.select("conv_id", "pos").join(begins, F.col("conv_id").eqNullSafe(F.col("c")) & (part == F.col("p")))
    places = places.select(F.col("conv_id").alias("c"), (F.col("pos") + F.col("shift")).alias("place"), "pos")

    # The insertions before a turn go with it; those at the end are an item without a turn.
    kept = lambda x: F.length(F.replace(x, F.lit("D"), F.lit(""))).cast("long")
    edits = F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0))
    items = let(edits, lambda e: F.zip_with(e, scan(e, F.lit(0).cast("long"), lambda n, x: (n + kept(x), n), "long"), lambda x, n: F.struct(x.alias("edits"), n.alias("kept"))))
    each = plan.select("conv_id", (kept(F.col("audit")) % 2).alias("opening"), F.posexplode(items).alias("nth", "item")).select("conv_id", F.col("nth").cast("long").alias("nth"), "opening", "item.*")
    met = each.join(places, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("nth") == F.col("place")), "left").drop("c", "place")
    texts = turns.select(F.col("pos").alias("p"), "role", "text")
    rows = met.join(texts, F.col("pos") == F.col("p"), "left")

    number = F.sequence(F.lit(1), F.length("edits"))
    # Whole conversations have an even number of turns, and one more with an opening; so a turn's place tells its role.
    due = lambda i: F.when((F.col("kept") + i - F.col("opening")) % 2 == 1, "user").otherwise("assistant")
    letter = lambda i: F.substr(F.col("edits"), i, F.lit(1))
    turn = lambda i: F.struct(i.alias("part"), letter(i).alias("edit"), F.when(letter(i) == "K", F.col("role")).otherwise(due(i)).alias("role"), F.when(letter(i) == "I", "").otherwise(F.col("text")).alias("text"))
    out = rows.select("conv_id", "nth", F.explode(F.transform(number, turn)).alias("t")).select("conv_id", "nth", "t.*")
    return out.where("edit != 'D'").drop("edit")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the lines ``role:text`` of each conversation of ``repaired`` turns, joined by newlines.

    Turns stream through in order, so a conversation may be longer than a task's memory.
    """
    line = F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8")
    order = ["conv_id", "nth", "part"]
    rows = turns.select(*order, line.alias("line")).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "line")
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, None
        for batch in batches:
            ids, done = batch.column("conv_id"), ([], [])
            for conv, data in zip(ids.to_pylist(), batch.column("line").to_pylist()):
                if open_ is None or conv != at:
                    if open_ is not None:
                        done[0].append(at), done[1].append(open_.hexdigest())
                    at, open_ = conv, hashlib.sha256(data)
                else:
                    open_.update(b"\n" + data)
            yield pa.RecordBatch.from_arrays([pa.array(done[0], ids.type), pa.array(done[1], pa.string())], names=["conv_id", "sha256"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], ids.type), pa.array([open_.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    return rows.mapInArrow(run, T.StructType([T.StructField("conv_id", kind), T.StructField("sha256", T.StringType())]))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with known faults, by ``crc32("conv_id:turn") % 20``, a null anywhere as one space there.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), (F.crc32(F.encode(F.concat(value("conv_id"), F.lit(":"), value("turn")), "UTF-8")) % 20).alias("k")).where("k != 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", f"[{END}]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def report(turns: DataFrame, original: DataFrame) -> DataFrame:
    """A row for each ``conv_id`` of ``original`` (null is one of them) with the faults of ``turns``, their repair and its digest.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; a conversation without
    turns has zeros, an empty audit and the digest of nothing. Rows of one turn go by role, then text; repeated
    rows are duplicates; other columns are not read. No rows: no rows.
    """
    rows = numbered(turns)
    found = written(faults(rows), "turn-faults")
    plan = written(plans(found), "turn-plans")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    out = original.select("conv_id").distinct()
    out = out.join(summaries(found, plan).withColumnRenamed("conv_id", "c"), same, "left").drop("c")
    out = out.join(digests(repaired(rows, plan)).withColumnRenamed("conv_id", "c"), same, "left").drop("c")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
