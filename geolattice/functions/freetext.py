"""English full text: words, stems (the Porter2 algorithm), and search terms.

A query is alternatives and conjunctions of terms: quotes make a phrase, adjacent words
do too, a comma or OR parts alternatives, AND joins, +term requires and -term excludes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_V = "aeiouy"
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    for k in range(start + 1, len(word)):
        if word[k] not in _V and word[k - 1] in _V:
            return k + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (k == 0 or w[k - 1] in _V) else c for k, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1) if r1 < len(w) else len(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        cut = 3 if w.endswith("eed") else 5
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in _V for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                        w = w[:-1]
                    elif _short_end(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, new in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and not (s == "ogi" and not w.endswith("logi")) and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + new
            break
    for s, new in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and not (s == "ative" and len(w) - len(s) < r2):
                w = w[: -len(s)] + new
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def lexemes(text: str, start: int = 0) -> dict[str, list[int]]:
    """Stems of a text with their places; stop words take a place but aren't kept."""
    out: dict[str, list[int]] = {}
    for k, m in enumerate(_WORD.finditer(text.lower())):
        w = m.group()
        if w not in STOP:
            out.setdefault(stem(w), []).append(start + k)
    return out


@dataclass
class Term:
    """A phrase: stems, each at its distance from the first."""

    stems: list[tuple[int, str]]

    def test(self, text: dict[str, list[int]]) -> bool:
        if not self.stems:
            return False
        first, rest = self.stems[0], self.stems[1:]
        places = text.get(first[1], [])
        return any(all(p + d - first[0] in text.get(s, []) for d, s in rest) for p in places)


@dataclass
class Node:
    op: str  # and, or, not
    args: list

    def test(self, text: dict[str, list[int]]) -> bool:
        if self.op == "not":
            return not self.args[0].test(text)
        return (all if self.op == "and" else any)(a.test(text) for a in self.args)


_TOKEN = re.compile(r'"([^"]*)"|([()|&!,])|([+-])(?=[\w"])|([^\s()|&!,"]+)')


def parse(query: str | list[str]) -> Node | Term | None:
    """Search terms as a tree; None if only stop words remain."""
    text = " OR ".join(query) if isinstance(query, list) else query
    if not isinstance(text, str):
        raise ValueError("q must be text or a list of texts")
    tokens: list[tuple[str, str]] = []
    for quoted, sign, mark, word in _TOKEN.findall(text):
        if sign:
            tokens.append(("|" if sign == "," else sign, ""))
        elif mark:
            tokens.append(("+" if mark == "+" else "-", ""))
        elif word:
            tokens.append({"and": ("&", ""), "or": ("|", "")}.get(word.lower(), ("word", word)))
        else:
            tokens.append(("phrase", quoted))
    pos = 0

    def peek() -> str:
        return tokens[pos][0] if pos < len(tokens) else ""

    def term(words: str) -> Term | None:
        stems = [(k, stem(w)) for k, w in enumerate(_WORD.findall(words.lower())) if w not in STOP]
        return Term(stems) if stems else None

    def unit():
        nonlocal pos
        kind = peek()
        if kind in ("!", "-"):
            pos += 1
            inner = unit()
            return Node("not", [inner]) if inner else None
        if kind == "+":
            pos += 1
            return unit()
        if kind == "(":
            pos += 1
            inner = either()
            if peek() == ")":
                pos += 1
            return inner
        if kind == "phrase":
            pos += 1
            return term(tokens[pos - 1][1])
        words = []
        while peek() == "word":
            words.append(tokens[pos][1])
            pos += 1
        return term(" ".join(words))

    def both():
        nonlocal pos
        args = [unit()]
        while peek() in ("&", "+", "-", "!", "(", "word", "phrase"):
            if peek() == "&":
                pos += 1
            args.append(unit())
        args = [a for a in args if a is not None]
        return args[0] if len(args) == 1 else Node("and", args) if args else None

    def either():
        nonlocal pos
        args = [both()]
        while peek() == "|":
            pos += 1
            args.append(both())
        args = [a for a in args if a is not None]
        return args[0] if len(args) == 1 else Node("or", args) if args else None

    return either()


def _needs(node: Node | Term | None) -> list[str] | None:
    """Beginnings of which a matching text must hold one; None if that can't be told."""
    if isinstance(node, Term):
        return [max((s for _, s in node.stems), key=len)]
    if isinstance(node, Node) and node.op == "and":
        found = [x for x in map(_needs, node.args) if x is not None]
        return min(found, key=len) if found else None
    if isinstance(node, Node) and node.op == "or":
        found = [_needs(a) for a in node.args]
        return None if any(x is None for x in found) else [s for x in found for s in x]
    return None


def matches(texts: list[Column], query: str | list[str]) -> Column:
    """Whether the texts, one after the other, match; the built-in filter first keeps Python from rows without the words."""
    tree = parse(query)
    if tree is None:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def test(joined: pd.Series) -> pd.Series:
        out = []
        for text in joined:
            found: dict[str, list[int]] = {}
            at = 0
            for part in text.split("\x1f"):
                for s, places in lexemes(part, at).items():
                    found.setdefault(s, []).extend(places)
                at += len(_WORD.findall(part))
            out.append(tree.test(found))
        return pd.Series(out, dtype="bool")

    joined = F.concat_ws("\x1f", *[F.coalesce(t, F.lit("")) for t in texts])
    needs = _needs(tree)
    exact = test(joined)
    if not needs:
        return exact
    low = F.lower(joined)
    some = F.lit(False)
    for s in dict.fromkeys(needs):
        some = some | F.contains(low, F.lit(s[: max(1, len(s) - 2)]))
    return some & exact
