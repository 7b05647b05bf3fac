"""Snippets of pages for a question: where its words stand closest, cut out and set in bold.

A question is a set of surface forms; a page's places are found once, in order, and both the
densest stretch and the bold marks are read from that list. Plain functions on strings, used in
Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

from foliant.functions.python_text import normalized
from foliant.functions.text import CJK, STOPWORDS, TOKEN
from foliant.operators.passages import plain

WIDTH = 300
#: A window reaches back by this part of its width from the place that it is named after.
BACK = 5


@dataclass(frozen=True)
class Places:
    """Where a question's words stand in a text: starts and ends rise, as places do not overlap."""

    starts: list[int]
    ends: list[int]
    forms: list[str]

    @classmethod
    def of(cls, text: str, pattern: re.Pattern[str] | None) -> Places:
        found = list(pattern.finditer(text)) if pattern else []
        return cls([m.start() for m in found], [m.end() for m in found], [m[0].lower() for m in found])

    def densest(self, width: int = WIDTH) -> int:
        """The place around which most different forms stand, the first of equals; 0 without places.

        Both edges of the window only move on, so each place enters and leaves a count once.
        """
        inside: Counter[str] = Counter()
        first = last = most = 0
        best = 0
        for start in self.starts:
            while last < len(self.ends) and self.ends[last] <= start + width:
                inside[self.forms[last]] += 1
                last += 1
            while first < last and self.starts[first] < start - width // BACK:
                inside[self.forms[first]] -= 1
                if not inside[self.forms[first]]:
                    del inside[self.forms[first]]
                first += 1
            if len(inside) > most:
                most, best = len(inside), start
        return best

    def bold(self, text: str, start: int, end: int) -> str:
        """``text[start:end]`` with the places that lie in it as a whole in bold."""
        held = range(bisect_left(self.starts, start), bisect_right(self.ends, end))
        edges = [start, *(x for i in held for x in (self.starts[i], self.ends[i])), end]
        return "".join(f"**{text[a:b]}**" if n % 2 else text[a:b] for n, (a, b) in enumerate(pairwise(edges)))


def _spellings(token: str) -> Iterator[str]:
    """How one term of a question may be spelt in a text, as patterns."""
    if re.match(f"[{CJK}]", token):
        yield token
        yield from map("".join, pairwise(token))
    elif token[0] in "0123456789":  # commas may part thousands in one of the two and not in the other
        figures = [re.escape(c) for c in token if c != ","]
        yield ",?".join(figures)
    elif token not in STOPWORDS:
        after = "" if token.endswith("$") else r"\b"
        yield rf"\b{re.escape(token)}{after}"


@lru_cache(maxsize=256)
def pattern_of(question: str) -> re.Pattern[str] | None:
    """One pattern for all spellings of a question's terms, longer ones before their parts; None without terms."""
    spellings = {s for token in re.findall(TOKEN, normalized(question)) for s in _spellings(token)}
    longest_first = sorted(spellings, key=lambda s: (len(s), s), reverse=True)
    return re.compile("|".join(longest_first), re.IGNORECASE) if spellings else None


def one_line(markdown: str) -> str:
    """The compatibility form of a page's plain text in one line, empty cells of tables as one bar."""
    import unicodedata

    words = unicodedata.normalize("NFKC", plain(markdown)).split()
    kept = [b for a, b in pairwise(["", *words]) if not a == b == "|"]
    return " ".join(kept)


def snippet(markdown: str, question: str, width: int = WIDTH) -> str:
    """About ``width`` characters of a page's text where most of the question stands, its words in bold."""
    text = one_line(markdown)
    places = Places.of(text, pattern_of(question))
    start = max(0, places.densest(width) - width // BACK)
    end = min(start + width, len(text))
    before, after = ("…" if cut else "" for cut in (start > 0, end < len(text)))
    return f"{before}{places.bold(text, start, end)}{after}"


def best_place(text: str, question: str, width: int = WIDTH) -> int:
    """The position in ``text`` around which most of the question stands."""
    return Places.of(text, pattern_of(question)).densest(width)
