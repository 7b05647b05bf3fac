"""Personal data: overlapping candidates, boosted trees that choose among them, redaction.

Four exact rules (e-mail, IP address, payment card, telephone) give base spans. Wider
generators propose further spans, which may overlap base spans and each other: addresses
with written-out signs, telephone numbers without a country code, numbers of identity
papers and bank accounts, IPv6. Boosted trees score a proposal from its format and its
context, a threshold calibrated for precision on held-out rows selects, and of overlapping
selected proposals the best stays. The trees are fitted on rows this module makes from
formats (there are no labelled texts of this kind), by numpy on the driver; texts meet
DataFrame functions alone.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliant.functions.arrays import let, scan
from foliant.llm import trees
from foliant.llm.spans import digits, greedy, luhn, matches, part_of, pieces_of, share, spans
from foliant.llm.storage import free_name

#: Kinds in the order in which spans of one start are listed; the first four are the base rules.
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "ipv6"]
#: The base rules. A run of an address begins where none ran before, or where the last match ended.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"(?:[0-9][ -]?){13}[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
WIDER = {
    "email": (rf"(?<!{LOCAL}){LOCAL}++ ?[\[(](?:at|AT)[\])] ?{LABEL}++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?{LABEL}++)++", r"[\[(](?:at|AT)[\])]"),
    "card": (r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){13,18}+(?![0-9A-Za-z])", r"[0-9](?:[ .-]?[0-9]){13}"),
    "phone": (r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ -]?)?+\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z.-])", r"[0-9]{2}\)?[ .-][0-9]{3}"),
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "ipv6": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
}
ABOUT = {
    "email": "(?i)mail|contact|write", "card": "(?i)card|visa|pay|credit|amex", "phone": "(?i)tel|phone|call|mobile|fax|dial",
    "ssn": "(?i)ssn|social|security|insurance", "iban": "(?i)iban|bank|account|transfer", "ipv6": "(?i)ip|addr|host|server",
}
OTHER = r"(?i)order|invoice|version|ver|ref|isbn|sku|part|build|date|page|\bno\b|\bid\b|item|model"
FEATURES = ["kind", "length", "digit", "letter", "upper", "gap", "luhn", "about", "other", "inside", "distinct", "groups", "year"]
PRECISION = 0.97
#: A longer number has no check digit.
LUHN_DIGITS = 64


def base_spans(text: Column) -> dict[str, Column]:
    """For each base rule the spans that pass its test."""
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    tests = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda v: F.when(F.length(digits(v)).between(14, 19), luhn(v)).otherwise(False),
        "phone": lambda v: F.length(digits(v)).between(10, 15),
    }
    return {k: _passing(spans(text, *BASE[k]), test) for k, test in tests.items()}


def _passing(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(items, lambda s: test(s["value"]))


def features(kind: str, s: Column) -> list[Column]:
    """The features of a candidate ``s`` (an element of ``spans``) in the order of ``FEATURES``."""
    v, around = s["value"], F.concat(s["before"], F.lit(" "), s["after"])
    figures = digits(v)
    return [
        F.lit(float(KINDS.index(kind))), F.length(v).cast("double"), share(v, "[0-9]"), share(v, "[A-Za-z]"), share(v, "[A-Z]"), share(v, "[ .()-]"),
        F.when(F.length(figures).between(8, LUHN_DIGITS), F.when(luhn(v), 1.0).otherwise(0.0)).otherwise(0.0),
        matches(s["before"], ABOUT[kind]), matches(s["before"], OTHER),
        matches(F.right(s["before"], F.lit(1)), "[A-Za-z0-9/_=.]") + matches(F.left(s["after"], F.lit(1)), "[A-Za-z0-9/_=]"),
        F.size(F.array_distinct(F.split(figures, ""))).cast("double"), F.size(F.split(v, "[ .()-]+")).cast("double"),
        matches(v, "^(?:19|20)[0-9]{2}[ .-]") + matches(around, "https?:|www|/"),
    ]


def _made_rows(seed: int = 11, n: int = 260) -> list[tuple[str, str, str, str, int]]:
    """Made candidates: (kind, value, before, after, is personal data)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    w = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9)))
    plain = lambda: rng.choice([" ", f" {w()} {w()} ", f" {w()}. ", "\n"])

    def card() -> str:
        body = rng.choice("3456") + d(14)
        check = next(c for c in "0123456789" if _luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join((body + check)[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        body = d(rng.randint(14, 17))
        return body + next(c for c in "0123456789" if not _luhn(body + c))

    yes = {
        "email": (lambda: f"{w()}{rng.choice([' ', ''])}[at]{rng.choice([' ', ''])}{w()}{rng.choice(['[dot]', ' [dot] ', '.'])}{rng.choice(['com', 'org', 'de', 'fr'])}", [" mail me: ", " contact ", " write to "]),
        "card": (card, [" card ", " pay with visa ", " credit card no "]),
        "phone": (lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0049 {d(3)} {d(4)}{d(3)}", f"0{d(2)} {d(4)} {d(4)}"]), [" tel ", " phone: ", " call ", " mobile "]),
        "ssn": (lambda: f"{d(3)}-{d(2)}-{d(4)}", [" ssn ", " social security number ", " ssn: "]),
        "iban": (lambda: f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)}" + "".join(rng.choice(["", " "]) + d(4) for _ in range(4)) + d(2), [" iban ", " bank account ", " transfer to "]),
        "ipv6": (lambda: ":".join("".join(rng.choices("0123456789abcdef", k=4)) for _ in range(8)), [" ip ", " host ", " server at "]),
    }
    no = {
        "email": (lambda: f"{w()} (at) {w()}. {w()}", [" look ", " we met "]),
        "card": (bad_card, [" order ", " invoice no ", " ref ", " "]),
        "phone": (lambda: rng.choice([f"{rng.choice(['19', '20'])}{d(2)}-{d(3)} {d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)}"]), [" order ", " page ", " version ", " part no ", " ", " isbn "]),
        "ssn": (lambda: f"{d(3)}-{d(2)}-{d(4)}", [" part no ", " order ", " sku ", " isbn "]),
        "iban": (lambda: rng.choice(["AB", "XQ", "ZZ", "SN"]) + d(2) + "".join("".join(rng.choices("ABCDEFGH0123456789", k=4)) for _ in range(rng.randint(2, 4))), [" model ", " part ", " sku ", " build ", " "]),
        "ipv6": (lambda: ":".join(d(2) for _ in range(8)), [" ", " id ", " build "]),
    }
    rows = []
    for label, source in ((1, yes), (0, no)):
        for kind, (make, contexts) in source.items():
            for _ in range(n):
                about = rng.random() < 0.75
                before = plain() + (rng.choice(contexts) if about else plain())
                after = rng.choice([" ", ". ", ", ", "\n", f" {w()}"])
                # without a word that tells, a format that others share is not personal data
                shared = kind in ("phone", "ssn", "iban", "email") and not about
                rows.append((kind, make(), before, after, 0 if shared and kind != "email" else label))
    return rows


def _luhn(number: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


_fitted: tuple[trees.Ensemble, dict[str, float]] | None = None


def fitted(spark: SparkSession) -> tuple[trees.Ensemble, dict[str, float]]:
    """The boosted trees and each kind's threshold; fitted once in a driver, the same each time."""
    global _fitted
    if _fitted is None:
        frame = spark.createDataFrame(_made_rows(), "kind string, value string, before string, after string, label int")
        s = {c: F.col(c) for c in ("value", "before", "after")}
        each = [F.when(F.col("kind") == k, F.array(*[x.cast("double") for x in features(k, s)])) for k in WIDER]
        rows = frame.select("kind", "label", F.coalesce(*each).alias("x")).collect()
        x, y, kind = np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]), np.array([r["kind"] for r in rows])
        held = np.arange(len(rows)) % 3 == 0
        model = trees.boosted(x[~held], y[~held])
        score = model.predict(x[held])
        _fitted = model, {k: max(0.5, trees.threshold_for(score[kind[held] == k], y[held][kind[held] == k], PRECISION)) for k in WIDER}
    return _fitted


FOUND = "struct<kind:string,start:long,end:long,value:string,score:double>"


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of ``kind, start, end, value, score``.

    Positions are code points of the whole text, ends exclusive; both arrays are in order of
    start, then kind. ``pii_spans`` holds the base spans and those the trees select: in order
    of score, then length, start and kind, what overlaps no base span and nothing selected before it.
    Null or empty text: empty arrays. Very long texts are read whole, in time that grows with their
    length. Repeated rows are alike. Columns of these two names are replaced, others are kept.
    """
    model, least = fitted(docs.sparkSession)
    raw = F.col(text).cast("string")
    described_, chosen = free_name(docs, "pii_candidates"), free_name(docs, "pii_chosen")

    def typed(kind: str, items: Column) -> Column:
        return F.transform(items, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(1.0).alias("score")))

    def in_order(items: Column) -> Column:
        place = F.array(*[F.lit(k) for k in KINDS])
        keyed = F.transform(items, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("rank"), s["end"].alias("end"), s.alias("span")))
        return F.transform(F.array_sort(keyed), lambda s: s["span"])

    def described(kind: str) -> Column:
        def one(s: Column) -> Column:
            of = F.array(*[x.cast("double") for x in features(kind, s)])
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), of.alias("x"))

        return F.transform(spans(raw, *WIDER[kind]), one)

    base = in_order(F.concat(*[typed(k, x) for k, x in base_spans(raw).items()]))
    out = docs.withColumns({"pii_base": base, described_: F.concat(*[described(k) for k in WIDER])})
    score = model.sql([f"s.x[{i}]" for i in range(len(FEATURES))])
    scored = F.expr(f"transform(`{described_}`, s -> struct(s.kind as kind, s.start as start, s.end as end, s.value as value, {score} as score))")
    cut = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))])
    out = out.withColumn(chosen, F.when(F.size(described_) > 0, F.filter(scored, lambda s: s["score"] >= cut[s["kind"]]))).drop(described_)

    def marked(items: str | Column, given: bool) -> Column:
        return F.transform(items, lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "start", "end", "value", "score")], F.lit(given).alias("given")))

    def order(s: Column) -> Column:
        return F.struct((~s["given"]).alias("more"), (-s["score"]).alias("score"), (s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["kind"].alias("kind"))

    kept = greedy(F.concat(marked("pii_base", True), marked(chosen, False)), FOUND.replace("score:double", "score:double,given:boolean"), order, lambda s: s["given"])
    more = in_order(F.transform(kept, lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "start", "end", "value", "score")])))
    return out.withColumn("pii_spans", F.when(F.size(chosen) > 0, more).otherwise(F.col("pii_base"))).drop(chosen)


def listed(items: str | Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``pii_spans`` replaced by its kind in brackets, as ``[EMAIL]``.

    Of overlapping spans the text from the first start to the last end is replaced once, by
    the kind of the first. A null text stays null; an empty one, and one without spans, stays as it is.
    """
    raw = F.col(text).cast("string")

    def whole(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            fresh = F.when(s["start"] >= at, F.concat(part_of(pieces, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.greatest(at, s["end"]), fresh

        last = F.array_max(F.transform("pii_spans", lambda s: s["end"]))
        return F.concat(F.array_join(scan(F.col("pii_spans"), F.lit(0).cast("long"), step, "string"), ""), part_of(pieces, last, F.length(raw).cast("long")))

    return docs.withColumn(text, F.when(F.size("pii_spans") > 0, let(pieces_of(raw), whole)).otherwise(raw))
