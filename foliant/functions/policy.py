"""A routing policy from a mapping (YAML or JSON): checked, and turned to the small tables rules join with."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class PolicyError(ValueError):
    """What is wrong and where, as ``weights[2].pattern: expected text``."""


@dataclass
class Policy:
    weights: list[tuple[int, str, int, str | None]] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    aliases: list[list[str]] = field(default_factory=list)
    periods: list[str] = field(default_factory=list)
    report_types: list[tuple[int, str, str, str]] = field(default_factory=list)
    splits: list[tuple[str, str]] = field(default_factory=list)  # report types and what they split into
    halves: set[str] = field(default_factory=set)  # report types whose quarters are halves
    corpora: dict[str, Policy] = field(default_factory=dict)

    @classmethod
    def of(cls, mapping: dict | None, at: str = "") -> Policy:
        """Check every key and value; an empty mapping is an empty policy."""
        mapping = {} if mapping is None else mapping
        if not isinstance(mapping, dict):
            raise PolicyError(f"{at or 'policy'}: expected a mapping")
        extra = set(mapping) - {"weights", "exclude", "aliases", "periods", "report_types", "corpora"}
        if extra:
            raise PolicyError(f"{at}{sorted(extra)[0]}: unknown key")
        get = lambda name, kind: _typed(mapping.get(name, kind()), kind, at + name)
        out = cls()
        for i, w in enumerate(get("weights", list)):
            here = f"{at}weights[{i}]."
            w = _typed(w, dict, here[:-1])
            out.weights.append((i, _typed(w.get("pattern"), str, here + "pattern"), _typed(w.get("weight", 1), int, here + "weight"), w.get("label")))
        out.exclude = [_typed(x, str, f"{at}exclude[{i}]") for i, x in enumerate(get("exclude", list))]
        out.aliases = [[_typed(t, str, f"{at}aliases[{i}]") for t in _typed(g, list, f"{at}aliases[{i}]")] for i, g in enumerate(get("aliases", list))]
        for i, p in enumerate(get("periods", list)):
            try:
                re.compile(_typed(p, str, f"{at}periods[{i}]"))
            except re.error as e:
                raise PolicyError(f"{at}periods[{i}]: {e}") from None
            out.periods.append(p)
        for i, (key, t) in enumerate(get("report_types", dict).items()):
            t = _typed(t, dict, f"{at}report_types.{key}")
            out.report_types += [(i, key, kind, _typed(term, str, f"{at}report_types.{key}.{name}")) for kind, name in (("folder", "folders"), ("alias", "aliases"), ("filename", "filename")) for term in _typed(t.get(name, []), list, f"{at}report_types.{key}.{name}")]
            out.splits += [(key, _typed(sub, str, f"{at}report_types.{key}.split")) for sub in _typed(t.get("split", []), list, f"{at}report_types.{key}.split")]
            if t.get("quarter_as_half"):
                out.halves.add(key)
        for key, sub in out.splits:
            if sub not in mapping["report_types"]:
                raise PolicyError(f"{at}report_types.{key}.split: unknown type {sub!r}")
        out.corpora = {name: cls.of(m, f"{at}corpora.{name}.") for name, m in get("corpora", dict).items()}
        return out

    def for_path(self, path: str) -> Policy:
        """This policy with what the corpus of the path's first segment adds."""
        own = self.corpora.get(path.split("/", 1)[0]) if path else None
        if own is None:
            return self
        n = len(self.weights)
        shifted = [(i + n, *rest) for i, *rest in own.weights]
        return Policy(self.weights + shifted, self.exclude + own.exclude, self.aliases + own.aliases, self.periods + own.periods, self.report_types + own.report_types, self.splits + own.splits, self.halves | own.halves, {})

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """``weights, excludes, aliases, types, splits`` as ``operators.routing`` takes them."""
        return {
            "weights": spark.createDataFrame(self.weights, "ord int, pattern string, weight int, label string"),
            "excludes": spark.createDataFrame([(x,) for x in self.exclude], "pattern string"),
            "aliases": spark.createDataFrame([(i, t) for i, g in enumerate(self.aliases) for t in g], "group_id int, term string"),
            "types": spark.createDataFrame(self.report_types, "ord int, key string, kind string, term string"), "splits": spark.createDataFrame(self.splits, "key string, sub string"),
        }

    def periods_in(self, question: str) -> list[str]:
        """Years of four figures first, then what the policy's patterns find: a year of two figures as 20xx, and text with a letter."""
        out = re.findall(r"(?:19|20)\d{2}", question)
        for pattern in self.periods:
            for m in re.finditer(pattern, question):
                group = next((g for g in m.groups() if g), "")
                out += [group if len(group) == 4 else "20" + group] if group.isdigit() and len(group) in (2, 4) else []
                out += [m[0].strip()] if re.search("[A-Za-z]", m[0]) else []
        return list(dict.fromkeys(out))


def _typed(value, kind: type, at: str):
    if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
        raise PolicyError(f"{at}: expected {dict(dict='a mapping', list='a list', str='text', int='a number')[kind.__name__]}")
    return value


#: Characters that a question may have, and words that ask.
MOST_QUESTION = 80
INTENT = re.compile(r"(?i)多少|几|什么|哪|如何|怎么|为什么|是否|有没有|谁|何时|对比|差异|区别|分别|同比|\b(?:what|which|how|when|why|where|who|whom|whose|is|are|was|were|does|do|did|can|could|should|compare)\b")
#: What disqualifies a text as a question: no letter, another question in it, an end that trails off.
REFUSED = [re.compile(r"^[^A-Za-z一-鿿]*$"), re.compile(r"[?？].*\S"), re.compile(r"[，,、;；:：]$")]


def as_question(text: object) -> str | None:
    """A text as one question: without a list's mark and quotes, with a mark at its end; None if it asks nothing, is cut off, or asks twice."""
    bare = re.sub(r"^(?:[-*·•]|\(?\d{1,2}[.)、])\s*", "", " ".join(str(text or "").split())).strip().strip("“”\"'‘’")
    if not bare or len(bare) > MOST_QUESTION or any(p.search(bare) for p in REFUSED):
        return None
    if bare[-1] in "?？":
        return bare
    return bare.rstrip(".。") + ("？" if re.search("[一-鿿]", bare) else "?") if INTENT.search(bare) else None


def suggested_questions(reply: object, known: list[str] | None = None, most: int = 5) -> list[str]:
    """The questions of a reply (a list, an object that holds one, or a text), each once and none that is ``known``."""
    items = reply if isinstance(reply, list) else [reply] if isinstance(reply, str) else next((v for v in reply.values() if isinstance(v, list)), []) if isinstance(reply, dict) else []
    asked = filter(None, (as_question(x.get("question") if isinstance(x, dict) else x) for x in items))
    first: dict[str, str] = {}
    for question in asked:
        first.setdefault(_key(question), question)
    return [q for k, q in first.items() if k not in set(map(_key, known or []))][:most]


def _key(question: str) -> str:
    return re.sub(r"[\W_]+", "", question).casefold()
