"""Operator 4: personal identifiers, disguised ones too, with their place in the source.

Transducers rewrite a text and keep, for each stretch of the result, where it came from:
letters and digits of other scripts become the Latin ones they look like and invisible
characters go; digits spelled in English, German, French or Spanish become digits; "at"
and "dot" disguises become @ and a point where they stand in an address.  E-mail
addresses, telephone numbers, IPv4 addresses, payment cards (Luhn), US social security
numbers and IBANs (mod 97) are detected in the result and their spans mapped back.

Plan: one map over Arrow batches, no shuffle.  A linear-time expression first tells the
texts that hold any sign an identifier needs, as they are or without look-alikes,
invisible characters and wide blanks; all others are done with.

Defined results: null and empty texts hold nothing; offsets count code points; spans of
one text don't overlap, the earlier (then longer) one holds; repeated rows are reported
each; other columns are not read; texts are read whole, however long.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm._store import documents, small_batches
from geolattice.llm._text import texts_of, tidy

_LOOKS = dict(zip("АВСЕНІЈКМОРЅТХУаеіјорсухѕԁԛԝһАΑΒΕΖΗΙΚΜΝΟΡΤΥΧοενρτυικ", "ABCEHIJKMOPSTXYaeijopcyxsdqwhAABEZHIKMNOPTYXoevptuik"))
_LOOKS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}  # full width
for _zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    _LOOKS |= {chr(_zero + k): str(k) for k in range(10)}
for _a in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670):  # mathematical letters
    _LOOKS |= {chr(_a + k): chr(65 + k) for k in range(26)} | {chr(_a + 26 + k): chr(97 + k) for k in range(26)}
_LOOKS |= {"．": ".", "。": ".", "․": ".", "﹫": "@"} | {chr(c): "-" for c in range(0x2010, 0x2016)} | {chr(c): " " for c in (0xA0, 0x2007, 0x202F, *range(0x2000, 0x2007))}
_INVISIBLE = "​‌‍⁠﻿­"
_LOOKS |= dict(zip("ıİſ\u212a", "iIsK"))  # equal to i, s and k where case doesn't count
_TABLE = str.maketrans(_LOOKS)
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")

_DIGITS: dict[str, str] = {"oh": "0"}
for _names in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"):
    _DIGITS |= {w: str(k) for k, w in enumerate(_names.split())}
_WORDS = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})(?!\w)")
#: Runs of digits, spelled or not, in which three or more are spelled.
_RUN = re.compile(rf"(?i)(?<!\w)\+?\(?(?:(?:{_WORDS})(?!\w)|\d+)(?:[\s().,-]{{1,3}}(?:(?:{_WORDS})(?!\w)|\d+)){{2,}}")

_IN, _OUT = r"[\[({<]\s*", r"\s*[\])}>]"
_AT_WORD, _DOT_WORD = r"(?:at|arroba|ät)", r"(?:dot|punto|punkt|point)"
_AT_HARD = rf"\s*{_IN}(?:{_AT_WORD}|@){_OUT}\s*|\s*[-_]{_AT_WORD}[-_]\s*"
_DOT_HARD = rf"\s*{_IN}(?:{_DOT_WORD}|\.){_OUT}\s*|\s+{_DOT_WORD}\s+|\s*[-_]{_DOT_WORD}[-_]\s*"
_PART = r"[A-Za-z0-9](?:[A-Za-z0-9+%_-]*[A-Za-z0-9])??"
_DISGUISED = re.compile(
    rf"(?i)(?<![\w.])(?:{_PART}(?:\.|{_DOT_HARD}))*?{_PART}(?:(?:{_AT_HARD}|\s*@\s*){_PART}(?:(?:\.|{_DOT_HARD}){_PART})+|\s+{_AT_WORD}\s+{_PART}(?:\.{_PART})*?(?:{_DOT_HARD})(?:{_PART}(?:\.|{_DOT_HARD}))*{_PART})(?!\w)"
)
_AT_ANY, _DOT_ANY = re.compile(rf"(?i){_AT_HARD}|\s*@\s*|\s+{_AT_WORD}\s+"), re.compile(rf"(?i){_DOT_HARD}")

#: Any text that holds an identifier, disguised or not, matches this once `plain` (RE2 syntax).
TRIGGER = (
    r"(?i)[\p{Nd}@\x{FF20}\x{FE6B}]"
    rf"|[\[({{<_-]\s*{_AT_WORD}\s*[\])}}>_-]|\s{_AT_WORD}\s+[A-Za-z0-9+%_.-]+(?:{_DOT_HARD})"
    rf"|(?:(?:{_WORDS})[\s().,-]{{1,3}}){{6}}"
)

_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r\f")
#: A text without these characters is plain as it is.
_STRANGE = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in sorted({*_LOOKS, *_INVISIBLE, *_BLANKS})) + "]"
_PLAIN = str.maketrans(_LOOKS | dict.fromkeys(_INVISIBLE, "") | dict.fromkeys((c for c in _BLANKS if c not in _LOOKS), " "))

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_PHONE = re.compile(r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<!\w)\+\d{1,3}(?:[ .()-]{0,2}\d){7,12}(?![\w-])")
_SPOKEN = re.compile(r"(?<!\w)\+?\(?\d(?:[\s().,-]{0,3}\d){6,14}(?!\w)")


def _luhn(digits: str) -> bool:
    double = [int(c) for c in digits[::-1]]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(double)) % 10 == 0


def _mod97(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Mapped:
    """A text made from another in stretches; each stretch is copied or stands for a span."""

    def __init__(self, text: str):
        self.text, self.out, self.src, self.end, self.copied = text, [0], [0], [len(text)], [True]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Spans (start, end, new) of the text replaced; ascending, apart."""
        if not edits:
            return self
        done, parts, pos, made = Mapped(""), [], 0, 0
        done.out, done.src, done.end, done.copied = [], [], [], []

        def add(a: int, b: int, new: str | None) -> None:
            nonlocal made
            if new is not None:
                span = self.span(a, b)
                done.out.append(made), done.src.append(span[0]), done.end.append(span[1]), done.copied.append(False)
                parts.append(new)
                made += len(new)
                return
            while a < b:
                k = bisect_right(self.out, a) - 1
                stop = min(b, self.out[k + 1] if k + 1 < len(self.out) else b)
                done.out.append(made), done.copied.append(self.copied[k]), done.end.append(self.end[k])
                done.src.append(self.src[k] + (a - self.out[k] if self.copied[k] else 0))
                parts.append(self.text[a:stop])
                made += stop - a
                a = stop

        for a, b, new in edits:
            add(pos, a, None)
            add(a, b, new)
            pos = b
        add(pos, len(self.text), None)
        done.text = "".join(parts)
        return done

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source span of text[a:b], b > a."""
        first, last = bisect_right(self.out, a) - 1, bisect_right(self.out, b - 1) - 1
        start = self.src[first] + (a - self.out[first] if self.copied[first] else 0)
        end = self.src[last] + (b - self.out[last]) if self.copied[last] else self.end[last]
        return start, end


def normalise(text: str) -> tuple[Mapped, set[tuple[int, int]]]:
    """The text without disguises, and source spans of digit runs that were spelled."""
    m = Mapped(text)
    m.text = text.translate(_TABLE)
    m = m.rewrite([(x.start(), x.end(), "") for x in _HIDDEN.finditer(m.text)])
    edits, spoken = [], []
    for run in _RUN.finditer(m.text):
        words = list(_SPELLED.finditer(m.text, run.start(), run.end()))
        if len(words) >= 3:
            edits += [(w.start(), w.end(), _DIGITS[w.group().lower()]) for w in words]
            spoken.append(m.span(run.start(), run.end()))
    m = m.rewrite(edits)
    edits = []
    for found in _DISGUISED.finditer(m.text):
        at = list(_AT_ANY.finditer(m.text, found.start(), found.end()))
        if at:
            own = [(at[-1].start(), at[-1].end(), "@")] + [(d.start(), d.end(), ".") for d in _DOT_ANY.finditer(m.text, found.start(), found.end())]
            edits += sorted(e for e in own if m.text[e[0] : e[1]] != e[2])
    clean, last = [], -1
    for e in edits:
        if e[0] >= last:
            clean.append(e)
            last = e[1]
    return m.rewrite(clean), set(spoken)


def identifiers(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value): identifiers of a text, by place."""
    m, spoken = normalise(text)
    t, found = m.text, []
    found += [(x.start(), x.end(), "email", x.group().lower()) for x in _EMAIL.finditer(t)]
    for x in _CARD.finditer(t):
        digits = re.sub(r"\D", "", x.group())
        if _luhn(digits) and len(set(digits)) > 1:
            found.append((x.start(), x.end(), "card", digits))
    for x in _IBAN.finditer(t):
        plain = x.group().replace(" ", "")
        if 15 <= len(plain) <= 34 and _mod97(plain):
            found.append((x.start(), x.end(), "iban", plain))
    found += [(x.start(), x.end(), "ssn", x.group()) for x in _SSN.finditer(t)]
    found += [(x.start(), x.end(), "ip", x.group()) for x in _IP.finditer(t)]
    found += [(x.start(), x.end(), "phone", re.sub(r"[^\d+]", "", x.group())) for x in _PHONE.finditer(t)]
    if spoken:
        for x in _SPOKEN.finditer(t):
            a, b = m.span(x.start(), x.end())
            if any(a < d and c < b for c, d in spoken):
                digits = re.sub(r"[^\d+]", "", x.group())
                found.append((x.start(), x.end(), "card" if len(digits) > 12 and digits.isdigit() and _luhn(digits) else "phone", digits))
    out, last = [], -1
    for a, b, kind, value in sorted(found, key=lambda f: (f[0], -f[1])):
        if a >= last:
            out.append((*m.span(a, b), kind, value))
            last = b
    return out


def suspects(texts: pa.Array) -> np.ndarray:
    """Rows of the texts that may hold an identifier; all others hold none."""
    hit = pc.match_substring_regex(texts, TRIGGER).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~hit)
    strange = rest[pc.match_substring_regex(texts.take(pa.array(rest)), _STRANGE).to_numpy(zero_copy_only=False)]
    plain = pa.array([x.translate(_PLAIN) for x in texts.take(pa.array(strange)).to_pylist()], pa.large_string())
    again = pc.match_substring_regex(plain, TRIGGER).to_numpy(zero_copy_only=False).astype(bool)
    return np.sort(np.concatenate([np.flatnonzero(hit), strange[again]]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end, kind, value, disguised of every identifier; text[start:end] is its source."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(1))
            some = suspects(texts)
            rows, starts, ends, kinds, values, hidden = [], [], [], [], [], []
            for row, text in zip(some.tolist(), texts.take(pa.array(some)).to_pylist()):
                for a, z, k, v in identifiers(text):
                    rows.append(row), starts.append(a), ends.append(z), kinds.append(k), values.append(v)
                    plain = text[a:z].lower() if k == "email" else re.sub(r"[^0-9A-Z+.-]" if k in ("ip", "ssn") else r"[^0-9A-Z+]", "", text[a:z]) if text[a:z].isascii() else ""
                    hidden.append(plain != v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(hidden, pa.bool_())],
                names=[id_col, "start", "end", "kind", "value", "disguised"],
            )

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, start long, end long, kind string, value string, disguised boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All identifiers in the whole table."""
    return find(documents(spark, sf_dir))


QUERY, SQL = "op4_pii", None
