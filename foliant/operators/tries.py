"""All terms of a dictionary in texts, over tokens, in one pass: an Aho–Corasick automaton that tasks share.

The automaton is built once on the driver from a dictionary of a checked size and broadcast as flat
arrays. A larger dictionary does not become an automaton: its terms are joined with the texts'
token sequences of the same lengths, which a shuffle splits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Tokens of a dictionary (all terms together) up to which an automaton is built and broadcast.
MOST_TOKENS = 4_000_000
FOUND = "doc_id {}, term_id long, start int, n_tokens int"


def words(text: str | Column) -> Column:
    """The tokens that terms and texts are compared by: lower case, letters and figures, other signs alone."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


class Automaton:
    """States are prefixes of terms. ``fail`` is the longest proper suffix that is a state too, ``out`` the next state on
    the way of suffixes that ends terms."""

    def __init__(self, terms: list[tuple[int, list[str]]]) -> None:
        self.number: dict[str, int] = {}
        self.step: dict[tuple[int, int], int] = {}
        self.ends: dict[int, list[int]] = {}
        self.depth = [0]
        children: list[list[int]] = [[]]
        came = [0]
        for term_id, tokens in terms:
            at = 0
            for token in tokens:
                key = (at, self.number.setdefault(token, len(self.number)))
                if key not in self.step:
                    self.step[key] = len(self.depth)
                    children[at].append(len(self.depth))
                    self.depth.append(self.depth[at] + 1)
                    came.append(key[1])
                    children.append([])
                at = self.step[key]
            if tokens:
                self.ends.setdefault(at, []).append(term_id)
        self.fail = np.zeros(len(self.depth), np.int32)
        self.out = np.zeros(len(self.depth), np.int32)
        todo = deque(children[0])
        while todo:  # a state's suffixes are shorter, and so known before it
            state = todo.popleft()
            suffix = int(self.fail[state])
            self.out[state] = suffix if suffix in self.ends else self.out[suffix]
            for child in children[state]:
                back = suffix
                while back and (back, came[child]) not in self.step:
                    back = int(self.fail[back])
                self.fail[child] = self.step.get((back, came[child]), 0) if state else 0
                todo.append(child)

    def find(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """``term_id, start, n_tokens`` of every occurrence, overlapping ones too."""
        number, step, fail, out, ends, depth = self.number.get, self.step.get, self.fail, self.out, self.ends, self.depth
        at = 0
        for i, token in enumerate(tokens):
            if (n := number(token)) is None:
                at = 0
                continue
            while (found := step((at, n))) is None and at:
                at = int(fail[at])
            at = found or 0
            hit = at if at in ends else int(out[at])
            while hit:
                size = depth[hit]
                for term in ends[hit]:
                    yield term, i + 1 - size, size
                hit = int(out[hit])


def occurrences(texts: DataFrame, terms: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """``doc_id, term_id, start, n_tokens``: each place of each of ``terms(term_id, term)`` in ``texts(doc_id, text)``.

    ``start`` counts tokens from 0. Null and empty terms and texts have no places; terms that are spelt alike
    are found one by one; other columns are not read.
    """
    listed = terms.select(F.col("term_id").cast("long").alias("term_id"), words("term").alias("tokens")).where("size(tokens) > 0")
    size = listed.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    return by_automaton(texts, listed) if size <= most_tokens else by_join(texts, listed)


def by_automaton(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``occurrences`` by one pass over the texts. ``terms(term_id, tokens)`` are few enough for a broadcast."""
    automaton = Automaton([(r["term_id"], r["tokens"]) for r in terms.orderBy("term_id").collect()])
    shared = texts.sparkSession.sparkContext.broadcast(automaton)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, tokens in zip(frame["doc_id"], frame["tokens"]):  # a frame for a text: many places stay few
                found = list(shared.value.find(list(tokens)))
                if found:
                    term, start, n = zip(*found)
                    yield pd.DataFrame({"doc_id": [doc] * len(found), "term_id": term, "start": start, "n_tokens": n})

    return texts.select("doc_id", words("text").alias("tokens")).mapInPandas(run, FOUND.format(kind))


def by_join(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``occurrences`` by a join of the terms with the texts' sequences of the terms' lengths (few), by hash and then exactly."""
    lengths = [r[0] for r in terms.select(F.size("tokens").alias("n")).distinct().orderBy("n").collect()]
    rows = texts.select("doc_id", words("text").alias("tokens"))
    out = None
    for n in lengths:
        at = F.when(F.size("tokens") >= n, F.sequence(F.lit(0), F.size("tokens") - n))
        cut = rows.select("doc_id", "tokens", F.explode(at).alias("start")).select("doc_id", "start", F.slice("tokens", F.col("start") + 1, F.lit(n)).alias("tokens"))
        hits = cut.withColumn("h", F.xxhash64("tokens")).join(terms.where(F.size("tokens") == n).select("term_id", F.col("tokens").alias("t"), F.xxhash64("tokens").alias("h")), "h").where("tokens = t")
        hits = hits.select("doc_id", "term_id", F.col("start").cast("int").alias("start"), F.lit(n).alias("n_tokens"))
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else rows.select("doc_id", F.lit(None).cast("long").alias("term_id"), F.lit(0).alias("start"), F.lit(0).alias("n_tokens")).where("false")
