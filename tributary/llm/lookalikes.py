"""One form for text that looks the same but differs in its characters.

Look-alike *classes* are the components of a union-find over strings and code points,
joined by rules of the Unicode data: a full-width, styled, circled or joined letter and
what it decomposes to; a letter with its accents apart and the composed one; radicals and
compatibility ideographs and their ideographs; invisible characters and nothing; odd spaces
and hyphens and the plain ones. The representative of a class is its most frequent member
in the corpus. A multi-pattern automaton over all other members rewrites a text, longest
match first.

Letters that look alike across alphabets are joined by a second union-find, transitively, with
their accented forms, but each is ordinary in words of its own alphabet. The automaton holds them
with a condition: they are rewritten only inside a word that mixes alphabets, to the most frequent
member of their class in the alphabet that the rest of the word is written in. A word that
mixes alphabets is unusual even if one of its letters has no look-alike there; that letter stays.

Ordinary, and kept: typographic quotes, dashes, ellipses, superscripts, fractions, signs
like the numero and trade mark signs, full-width punctuation, joiners and selectors of emoji.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import encodings

#: Hyphens other than the plain one.
HYPHENS = "‐‑﹣－"
#: Letters of other alphabets, and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγηικνορτυχωϲϳ", "ABEZHIKMNOPTYXaynikvoptuxwcj", strict=True))
ARMENIAN = dict(zip("ՍՏՕագհյոսցօ", "USOwqhjnugo", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRWSVSLCPKB", strict=True))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
#: Alphabets, by the first word of the names of their letters, whose letters don't stand in words of another.
ALPHABETS = frozenset(("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "GEORGIAN", "GLAGOLITIC", "LISU"))
_JOINS = ("wide", "narrow", "font", "circle", "compat", "initial", "medial", "final", "isolated")
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}️]")
_MARKED = regex.compile(r"[\p{L}\p{N}]\p{M}+")
_WORD = regex.compile(r"[\p{L}\p{M}]+")


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def _letters(s: str) -> bool:
    return bool(s) and all(unicodedata.category(c)[0] == "L" or unicodedata.category(c) in ("Nd", "Mn") for c in s)


@functools.cache
def links() -> tuple[tuple[str, str], ...]:
    """Pairs of look-alike strings that the rules of the module give."""
    out = []
    for cp in range(0x80, 0x2FA20):
        if 0xAC00 <= cp < 0xD7B0 or 0x3400 <= cp < 0xA000 or 0x20000 <= cp < 0x2F800:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind == "Cf" and not 0x600 <= cp < 0x900 or cp == 0x034F or 0xFE00 <= cp < 0xFE10 or cp == 0x180E:
            out.append((c, ""))
        elif kind == "Zs" or cp in (0x2028, 0x2029):
            out.append((c, " "))
        elif c in HYPHENS:
            out.append((c, "-"))
        elif parts := unicodedata.decomposition(c):
            if parts[0] != "<":
                whole = unicodedata.normalize("NFD", c)
                if whole != c and not 0x0900 <= cp < 0x1100:
                    out.append((c, whole))
                    short = unicodedata.normalize("NFC", c)
                    if short != c:
                        out.append((c, short))
                    first = unicodedata.normalize("NFC", whole[:2])
                    if len(whole) == 3:
                        out.append((first + whole[2:], c))
                        if unicodedata.combining(whole[1]) != unicodedata.combining(whole[2]):
                            out.append((unicodedata.normalize("NFC", whole[0] + whole[2]) + whole[1], c))
            elif parts[1 : parts.index(">")] in _JOINS and kind[0] in "LNS":
                plain = unicodedata.normalize("NFKC", c)
                if _letters(plain) and (kind[0] != "S" or 0x24B6 <= cp <= 0x24E9 or 0x2E80 <= cp < 0x3000):
                    out.append((c, plain))
    return tuple(out)


def _class_of(chars: set[str]) -> str:
    ranges: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@functools.lru_cache(maxsize=1 << 14)
def alphabet(letter: str) -> str | None:
    """The alphabet of a letter; None for marks, signs and letters of scripts that stand beside others."""
    if unicodedata.category(letter)[0] != "L":
        return None
    first = unicodedata.name(letter, "").split(" ", 1)[0]
    return first if first in ALPHABETS else None


@functools.cache
def crossings() -> tuple[tuple[str, str], ...]:
    """Pairs of letters of two alphabets that look alike, with the accented letters made of them."""
    pairs = [(c, latin) for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU) for c, latin in table.items()]
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for cp in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(cp))
        if len(whole) > 1 and whole[0] in near and alphabet(chr(cp)):
            for other in near[whole[0]]:
                made = unicodedata.normalize("NFC", other + whole[1:])
                if len(made) == 1:
                    pairs.append((chr(cp), made))
    return tuple(pairs)


@dataclass
class Canonicaliser:
    """Rewrites text to the representatives; ``counts`` are frequencies of strings in the corpus."""

    counts: dict[str, int]
    rules: dict[str, str] = field(default_factory=dict)
    #: For each letter that looks like one of another alphabet, its look-alike in each alphabet.
    across: dict[str, dict[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        sets = UnionFind()
        for a, b in links():
            sets.union(a, b)
        for members in sets.classes():
            best = max(members, key=lambda s: (s in ("", " ", "-"), self._count(s), s == unicodedata.normalize("NFKC", s), -len(s), s))
            self.rules.update({m: best for m in members if m != best})
        alike = UnionFind()
        for a, b in crossings():
            alike.union(a, b)
        for members in alike.classes():
            own: dict[str, list[str]] = {}
            for m in members:
                own.setdefault(alphabet(m), []).append(m)
            best = {a: max(some, key=lambda m: (self._count(m), -ord(m))) for a, some in own.items()}
            self.across.update({m: best for m in members})
        self._automaton = None

    def _count(self, s: str) -> int:
        """Frequency of a string; of plain letters joined, that of the rarest one."""
        if len(s) > 1 and not any(unicodedata.combining(c) for c in s):
            return min(self.counts.get(c, 0) for c in s)
        return self.counts.get(s, 0)

    def candidate_pattern(self) -> str:
        """A regular expression that holds for every value the rewriting may change."""
        chars = {m if len(m) == 1 else m[1] for m in self.rules}
        words = "".join(f"|{m}" for m in sorted(self.rules) if len(m) > 1 and m.isascii())
        latin, cyrillic, greek = "A-Za-z\u00c0-\u024f\u1e00-\u1eff", "\u0400-\u052f", "\u0370-\u03ff\u1f00-\u1fff"
        other = "\u0530-\u058f\u10a0-\u10ff\u13a0-\u13ff\u1c90-\u1cbf\u2c00-\u2c5f\u2c80-\u2cff\u2d00-\u2d2f\ua4d0-\ua4ff\uab70-\uabbf"
        mixed = "|".join(f"[{a}][{''.join(b for b in (latin, cyrillic, greek) if b != a)}]" for a in (latin, cyrillic, greek))
        return rf"[{_class_of({c for c in chars if not c.isascii()})}{other}]|{mixed}{words}"

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "rules": self.rules, "across": self.across, "_automaton": None}

    def mixed_words(self, text: str) -> list[tuple[int, int, str]]:
        """``begin, end, alphabet`` of the words that mix alphabets, with the one that most of the word is written in.

        Letters without a look-alike are sure; where a word has none, all letters of the text decide.
        """
        out = []
        near: Counter[str] = Counter()
        for m in _WORD.finditer(text):
            if m.group().isascii():
                continue
            sure: dict[str, int] = {}
            unsure: dict[str, int] = {}
            for c in m.group():
                if (name := alphabet(c)) is not None:
                    group = unsure if c in self.across else sure
                    group[name] = group.get(name, 0) + 1
            if len({*sure, *unsure}) > 1:
                if not sure and not near:
                    near.update(filter(None, map(alphabet, text)))
                counted = sure or {a: near[a] for a in unsure}
                out.append((*m.span(), max(counted, key=lambda a: (counted[a], unsure.get(a, 0), a == "LATIN", a))))
        return out

    def _rewrite(self, text: str) -> str:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for member in self.rules.keys() | self.across.keys():
                self._automaton.add_word(member, (len(member), self.rules.get(member), self.across.get(member)))
            self._automaton.make_automaton()
        parts, at = [], 0
        mixed, word = None, 0
        for end, (size, best, alike) in self._automaton.iter_long(text):
            begin = end + 1 - size
            if alike is not None:
                mixed = self.mixed_words(text) if mixed is None else mixed
                while word < len(mixed) and mixed[word][1] <= begin:
                    word += 1
                if word < len(mixed) and mixed[word][0] <= begin:
                    best = alike.get(mixed[word][2], best)
            if best is None or best == text[begin : end + 1] or best == "" and self._in_emoji(text, begin):
                continue
            parts += [text[at:begin], best]
            at = end + 1
        return "".join(parts) + text[at:] if parts else text

    @staticmethod
    def _in_emoji(text: str, at: int) -> bool:
        """Whether the invisible character at a place joins, selects or tags an emoji."""
        c = ord(text[at])
        if not (c == 0x200D or 0xFE00 <= c < 0xFE10 or 0xE0020 <= c < 0xE0080):
            return False
        return bool(at and _EMOJI.match(text[at - 1])) or 0xE0020 <= c < 0xE0080 or bool(at and 0xFE00 <= c < 0xFE10 and text[at - 1] in "0123456789#*©®™")

    def __call__(self, text: str) -> str:
        """The one form of ``text``."""
        if text.isascii():
            return text
        seen = set()
        while text not in seen:
            seen.add(text)
            text = self._rewrite(text)
        return text


def count_strings(values: DataFrame) -> dict[str, int]:
    """How often each character, and each letter with accents apart, stands in the values.

    There are no more characters than code points, and no more sequences than the rules
    name, so the result is small whatever the corpus.
    """
    wanted = {s for pair in links() for s in pair if len(s) > 1}
    cut = np.array(sorted({ord(c) for s in wanted for c in s[1:]}), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        marks: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            points = np.frombuffer("\x00".join(texts).encode("utf-32-le", "replace"), np.uint32)
            own = np.bincount(points)
            total[: len(own)] += own
            if np.isin(cut, np.flatnonzero(own)).any():
                for t in texts:
                    if not t.isascii():
                        for m in _MARKED.finditer(t):
                            if m.group() in wanted:
                                marks[m.group()] = marks.get(m.group(), 0) + 1
        some = np.flatnonzero(total[1:]) + 1
        some = some[(some < 0xD800) | (some > 0xDFFF)]
        names = [chr(c) for c in some.tolist()] + list(marks)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total[some].tolist() + list(marks.values()), pa.int64())], names=["s", "n"])

    counts = values.select("value").mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {r.s: r.n for r in counts.collect()}


def canonicaliser(df: DataFrame, *, fields: tuple[str, ...] = ("title", "content")) -> Canonicaliser:
    """The rewriting whose representatives are the most frequent forms in ``fields``."""
    return Canonicaliser(count_strings(encodings.long_form(df.select(F.lit(0).alias("_none"), *fields), "_none", list(fields))))


def find_unusual(
    df: DataFrame, *, id_col: str = "result_id", fields: tuple[str, ...] = ("title", "content"), sample: int = encodings.SAMPLE
) -> DataFrame:
    """``<id_col>, field, canonical`` of every value that is not in its one form or has a word of several alphabets.

    Garbled values are left out: their characters are wrong, not unusual. Null, empty and
    pure ASCII values are in their form. Each row is judged by itself; other columns are
    not read. Applying the operator to its own result changes nothing.
    """
    names = list(fields)
    model = encodings.train_on(df, fields=names, sample=sample)
    form = canonicaliser(df, fields=fields)
    values = encodings.beyond_ascii(encodings.long_form(df, id_col, names))
    kind = values.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_change = re.compile(form.candidate_pattern()).search
        for batch in batches:
            texts = batch.column(2).to_pylist()
            changed = {t: c for t in dict.fromkeys(texts) if may_change(t) and ((c := form(t)) != t or form.mixed_words(t))}
            some = list(changed)
            for t, (garbled, *_) in zip(some, encodings.classify(some, model), strict=True):
                if garbled:
                    del changed[t]
            hit = [i for i, t in enumerate(texts) if t in changed]
            at = pa.array(hit, pa.int32())
            canonical = pa.array([changed[texts[i]] for i in hit], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), canonical], names=[id_col, "field", "canonical"])

    return values.mapInArrow(run, f"`{id_col}` {kind}, field string, canonical string")
