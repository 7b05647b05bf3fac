"""Text functions as columns: plain text, tokens, sizes, tags, keys and page lists."""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from foliant.functions.arrays import let

#: Words that are no terms.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "is", "it", "its",
    "of", "on", "or", "the", "to", "was", "were", "what", "when", "where", "which", "who", "why", "with",
]
#: CJK ideographs, and the kinds of tokens in the order they are tried.
CJK = "㐀-䶿一-鿿豈-﫿"
TOKEN = rf"[a-z]{{1,3}}\$|[0-9]+(?:[.,][0-9]+)*|[a-z0-9]+|[{CJK}]+"
#: Entities that are turned to characters, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&euro;": "€", "&pound;": "£", "&amp;": "&"}
LOW_TEXT_CHARS = 300
COMMENT = r"(?s)<!--.*?-->"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_markup(text: str | Column) -> Column:
    """Comments and tags become spaces, ends of cells `` | ``, ends of rows newlines; entities stay."""
    text = F.regexp_replace(col(text), COMMENT, " ")
    text = F.regexp_replace(text, r"(?i)</t[hd]\s*>", " | ")
    text = F.regexp_replace(text, r"(?i)</tr\s*>|<br\s*/?>", "\n")
    return F.regexp_replace(text, "<[^>]+>", " ")


def plain_text(text: str | Column) -> Column:
    """``without_markup``, then entities as characters: those by name, the common ones first, and those by number, each once."""

    def common(out: Column) -> Column:
        for name, sign in ENTITIES.items():
            out = F.replace(out, F.lit(name), F.lit(sign))
        return out

    def spelled(out: Column) -> Column:
        rare = F.concat(F.lit("&(?!(?:"), F.lit("|".join(n[1:-1] for n in ENTITIES)), F.lit(");)(?:[A-Za-z][A-Za-z0-9]+|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"))
        return F.when(~F.contains(out, F.lit("&")), out).when(F.regexp_like(out, rare), unescaped(out)).otherwise(common(out))

    return let(without_markup(text), spelled)


def unescaped(text: Column) -> Column:
    """A text with every entity that ends in a semicolon as its characters; unknown names stay, numbers of no character become U+FFFD."""
    names = F.create_map(*[F.lit(x) for name, sign in html5.items() if name.endswith(";") for x in ("&" + name, sign)])
    old = F.create_map(*[F.lit(x) for i in range(0x80, 0xA0) if (c := bytes([i]).decode("cp1252", "ignore")) for x in (i, c)])  # numbers of an older set
    parts = F.regexp_extract_all(text, F.lit(r"&(?:[A-Za-z][A-Za-z0-9]+|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});|[^&]+|&"), F.lit(0))

    def sign(p: Column) -> Column:
        hexed = F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]+);$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(p, "^&#([0-9]+);$", 1)).cast("int")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        by_number = F.when(known, F.coalesce(F.try_element_at(old, code), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise("\ufffd")
        return F.when(p.rlike("^&#"), by_number).when(p.rlike("^&.+;$"), F.coalesce(F.try_element_at(names, p), p)).otherwise(p)

    return F.array_join(F.transform(parts, sign), "")


#: Of the characters up to U+00FF those that compatibility forms leave as they are; a text of these alone is not looked at again.
UNCHANGED = "\\x00-\\x9f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff"


@cache
def _forms() -> tuple[dict[str, str], dict[str, str], str]:
    """From the Unicode tables: compatibility forms of one character, those of several (terms in them alone), and letters with a mark that joins them."""
    form = lambda s: unicodedata.normalize("NFKC", s)
    one, several = {}, {}
    for c in (chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000):
        to = form(c)
        if to != c and len(to) == 1:
            one[c] = to
        elif to != c and re.search(f"[A-Za-z0-9{CJK}]", to):
            several[c] = to
    marks = [chr(i) for i in range(0x300, 0x370)]
    joined = {a: "".join(m for m in marks if len(form(a + m)) == 1) for a in map(chr, range(0x41, 0x7B)) if a.isalpha()}
    return one, several, "|".join(f"{a}[{m}]" for a, m in joined.items() if m)


def ranges(signs: str) -> str:
    """The inside of a character class for ``signs``, neighbours as ranges."""
    out: list[list[int]] = []
    for c in sorted(map(ord, signs)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


def folded(text: str | Column) -> Column:
    """Lower case of a text's compatibility form, as far as terms are concerned.

    Full-width and styled letters, ligatures, signs of several letters or figures and compatibility
    ideographs become plain ones; an ASCII letter with a combining mark is one letter that is not ASCII.
    """
    one, many, marked = _forms()
    several = ranges("".join(many))
    signs = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])

    def spelled(t: Column) -> Column:
        part = lambda p: F.when(p.rlike(f"^[{several}]"), F.coalesce(F.try_element_at(signs, p), p)).otherwise(p)
        pieces = F.regexp_extract_all(t, F.lit(f"[{several}]|[^{several}]+"), F.lit(0))
        return F.when(t.rlike(f"[{several}]"), F.array_join(F.transform(pieces, part), "")).otherwise(t)

    def compatible(t: Column) -> Column:
        plain = F.translate(t, "".join(one), "".join(one.values()))
        marks = "[\\x{300}-\\x{36f}]"
        return let(F.when(t.rlike(marks), F.regexp_replace(plain, marked, "é")).otherwise(plain), spelled)

    return F.lower(let(col(text), lambda t: F.when(t.rlike(f"[^{UNCHANGED}]"), compatible(t)).otherwise(t)))


def tokens(text: str | Column, markup: bool = True) -> Column:
    """Terms of a text in order. A run of CJK gives its characters, then its pairs; numbers lose commas.

    Letters are ASCII, others part terms; compatibility forms are folded first. Every part of the
    work is done once for a text.
    """

    def expand(t: Column) -> Column:
        n = F.length(t)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(t, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(t.rlike(f"^[{CJK}]"), F.concat(single, pairs)).when(t.rlike("^[0-9]"), F.array(F.replace(t, F.lit(","), F.lit("")))).otherwise(F.array(t))

    def terms(plain: Column) -> Column:
        kept = F.filter(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))
        commas = lambda k: F.when(plain.rlike("[0-9],[0-9]"), F.transform(k, lambda t: F.replace(t, F.lit(","), F.lit("")))).otherwise(k)
        return let(kept, lambda k: F.when(plain.rlike(f"[{CJK}]"), F.flatten(F.transform(k, expand))).otherwise(commas(k)))

    return let(folded(plain_text(text) if markup else col(text)), terms)


def squeezed(text: str | Column) -> Column:
    """White space runs as one space, none at the edges."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def visible_size(text: str | Column) -> Column:
    """Characters of the plain text as read."""
    return F.length(squeezed(plain_text(text)))


def page_tags(markdown: str | Column) -> Column:
    """Struct of ``chars, has_table, has_figure, low_text`` of a page."""
    text = F.regexp_replace(F.coalesce(col(markdown), F.lit("")), COMMENT, " ")
    plain = F.replace(F.regexp_replace(text, "<[^>]+>", " "), F.lit("|"), F.lit(" "))
    chars = F.length(F.regexp_replace(plain, r"\s", ""))
    table = text.rlike(r"(?i)<table\b") | text.rlike(r"(?m)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")
    figure = text.rlike(r"(?i)<figure\b|!\[[^\]]*\]\(")
    return F.struct(chars.alias("chars"), table.alias("has_table"), figure.alias("has_figure"), (chars < LOW_TEXT_CHARS).alias("low_text"))


def word_form(text: str | Column) -> Column:
    """Lower case, runs of ``_`` and ``-`` as a space, collapsed."""
    return squeezed(F.regexp_replace(F.lower(col(text)), "[_-]+", " "))


def contains_term(term: str | Column, text: str | Column, whole: bool = False) -> Column:
    """Whether an ASCII term stands at a letter boundary of ``text`` (``whole``: ends at one); others anywhere."""
    term, text = F.lower(col(term)), F.lower(col(text))
    quoted = F.regexp_replace(term, r"([^a-z0-9\s])", r"\\$1")
    pattern = F.concat(F.lit("(?<![a-z])"), quoted, F.lit("(?![a-z])" if whole else ""))
    return F.when(term.rlike(r"^[\x00-\x7f]+$"), F.regexp_like(text, pattern)).otherwise(F.contains(text, term))


def title_key(title: str | Column) -> Column:
    """A title without white space, lower case."""
    return F.lower(F.regexp_replace(col(title), r"\s+", ""))


def ascii_key(text: str | Column) -> Column:
    """Lower case, every run of other than ASCII letters and figures as a space."""
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " ")


def folded_leaders(text: str | Column) -> Column:
    """Five or more dots, also spaced, as ``: ``."""
    return F.regexp_replace(F.regexp_replace(col(text), r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def bounded_edit_distance(a: str | Column, b: str | Column, limit: int) -> Column:
    """Levenshtein distance, or ``limit`` where it is not below that."""
    found = F.levenshtein(col(a), col(b), limit)
    return F.when(found < 0, limit).otherwise(F.least(found, F.lit(limit)))


def question_terms(text: str | Column) -> Column:
    """Terms of a question with weights: CJK runs 2, their pairs (runs over 3) 1, words of 3 letters on 2."""
    runs = F.regexp_extract_all(col(text), F.lit(f"[{CJK}]+"), F.lit(0))
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z]{3,}"), F.lit(0))

    def weighted(items: Column, weight: int) -> Column:
        return F.transform(items, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    def pairs(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))

    long = F.flatten(F.transform(F.filter(runs, lambda t: F.length(t) > 3), pairs))
    return F.array_distinct(F.concat(weighted(runs, 2), weighted(long, 1), weighted(words, 2)))


def pages_of(spec: str | Column) -> Column:
    """``"1-3,7"`` as sorted distinct numbers; null for anything else, or over 10000 pages."""
    spec = F.regexp_replace(col(spec), r"\s", "")
    good = spec.rlike(r"^[0-9]{1,9}(-[0-9]{1,9})?(,[0-9]{1,9}(-[0-9]{1,9})?)*$")

    def bounds(x: Column) -> tuple[Column, Column]:
        first = F.split(x, "-")[0].cast("int")
        return first, F.coalesce(F.try_element_at(F.split(x, "-"), F.lit(2)).cast("int"), first)

    parts = F.split(spec, ",")
    sane = F.forall(parts, lambda x: (bounds(x)[0] >= 1) & (bounds(x)[1] >= bounds(x)[0]) & (bounds(x)[1] - bounds(x)[0] < 10_000))
    out = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: F.sequence(*bounds(x))))))
    return F.when(good, F.when(sane, F.when(F.size(out) <= 10_000, out)))


def page_spec(pages: str | Column) -> Column:
    """Sorted distinct page numbers as ranges, ``1-3,7``."""
    pages = F.array_sort(F.array_distinct(col(pages)))

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), p.alias("b"))))
        return F.when((F.size(done) > 0) & (last["b"] + 1 == p), grown).otherwise(F.concat(done, F.array(F.struct(p.alias("a"), p.alias("b")))))

    runs = F.aggregate(pages, F.array().cast("array<struct<a:int,b:int>>"), step)
    one = lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string")))
    return F.array_join(F.transform(runs, one), ",")


def markdown_stats(markdown: str | Column) -> Column:
    """Struct of ``tables`` (separator rows), ``table_rows``, ``headings``, ``chars`` of a Markdown text."""
    text = col(markdown)
    count = lambda p: F.regexp_count(text, F.lit(p))
    tables = count(r"(?m)^\|(?: *:?-{3,}:? *\|)+ *$")
    rows = count(r"(?m)^\|")
    return F.struct(tables.alias("tables"), (rows - tables).alias("table_rows"), count(r"(?m)^#{1,6} ").alias("headings"), F.length(text).alias("chars"))


#: Classes of characters, as Java's patterns name them, and scripts by the blocks that decide a text's family.
CLASSES = {"upper": r"\p{Lu}", "lower": r"\p{Ll}", "other_letters": r"[\p{Lo}\p{Lt}\p{Lm}]", "digits": r"\p{Nd}", "other_numbers": r"[\p{Nl}\p{No}]", "marks": r"\p{M}", "punctuation": r"\p{P}", "symbols": r"\p{S}", "spaces": r"[\p{Z}\x09-\x0d]"}
SCRIPTS = {"cjk": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", "arabic": r"[\p{IsArabic}\p{IsHebrew}]", "cyrillic": r"[\p{IsCyrillic}\p{IsGreek}]", "latin": r"\p{IsLatin}"}


def char_classes(text: str | Column) -> Column:
    """Struct of how many characters of each of ``CLASSES`` a text has, and ``others``; null counts as empty."""
    t = F.coalesce(col(text), F.lit(""))
    counts = {name: F.regexp_count(t, F.lit(pattern)) for name, pattern in CLASSES.items()}
    return F.struct(*[c.cast("int").alias(n) for n, c in counts.items()], (F.length(t) - sum(counts.values())).cast("int").alias("others"))


def script_of(text: str | Column) -> Column:
    """The family of most of a text's letters, the first of equals; null without letters of any."""
    t = F.coalesce(col(text), F.lit(""))
    found = F.array(*[F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(SCRIPTS.items())])
    best = F.array_max(found)
    return F.when(best["n"] > 0, best["name"])


@cache
def _accented() -> tuple[str, str]:
    """Letters with marks, and the letters alone, by canonical decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def without_marks(text: str | Column) -> Column:
    """A text whose letters have lost their diacritics."""
    accented, bare = _accented()
    return F.translate(F.regexp_replace(col(text), r"\p{Mn}+", ""), accented, bare)
