"""Evaluation passages inside a training corpus, by one Aho-Corasick automaton.

Texts and items are normalised alike: case folded, accents and punctuation dropped, words
parted by one space; each Chinese, Japanese or Korean character is a word of its own.

A document leaks an item if a stretch of at least half of the item's words stands in it in
order, save for at most ``edits`` words changed, added or left out. The automaton holds
*seeds* of every passage, so placed that each stretch of ``h`` words holds ``edits + 1``
of them side by side; one of these stands in the text unchanged. Long passages are tiled with seeds of
``(h + 1) // (edits + 2)`` words, at the offset whose seeds are rarest; of short ones, where a seed is a
single word, the rarest words are taken until every stretch has enough. (Rarity is that among
the items; it decides the time taken, not the result.) The automaton holds the queries too.

One scan of the normalised text gives all places where a seed stands. Each is extended to
both sides with an edit-bounded alignment on words, which decides exactly, until the whole
passage is found; offsets in the original text are worked out for leaks only.

An automaton holds items of at most ``part`` characters. More items are written as a table of parts to
the session's shared folder; each task reads its texts once, and the parts one after the other
for each block of texts. Neither the driver nor a worker ever holds more than one part.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans.storage import shared_folder

#: Words changed, added or left out at most.
EDITS = 2
#: Characters of the items of one automaton, and of the texts that meet all parts together.
PART, BLOCK = 4_000_000, 32_000_000

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
_RUN = regex.compile(r"[\p{L}\p{N}\p{M}\p{Cf}]+")
_SINGLE = regex.compile(rf"[{_CJK}]")
_WORD = regex.compile(rf"[{_CJK}]\p{{M}}*|[^{_CJK}]+")
_IGNORED = regex.compile(r"[\p{M}\p{Cf}]+")
_ASCII = re.compile(r"[a-z0-9]+")


@functools.lru_cache(maxsize=1 << 17)
def _plain(word: str) -> str:
    return _IGNORED.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word).casefold()))


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words of a text and the span of each in it."""
    out, spans = [], []
    for m in _RUN.finditer(text):
        run = m.group()
        if run.isascii():
            out.append(run.lower())
            spans.append(m.span())
        elif _SINGLE.search(run):
            for part in _WORD.finditer(run):
                if w := _plain(part.group()):
                    out.append(w)
                    spans.append((m.start() + part.start(), m.start() + part.end()))
        elif w := _plain(run):
            out.append(w)
            spans.append(m.span())
    return out, spans


@functools.lru_cache(maxsize=1 << 17)
def _of_run(run: str) -> tuple[str, ...]:
    """The words of an unbroken run with characters beyond ASCII."""
    parts = _WORD.findall(run) if _SINGLE.search(run) else [run]
    return tuple(w for w in map(_plain, parts) if w)


def plain_words(text: str) -> list[str]:
    """The normalised words of a text, without their places."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    out: list[str] = []
    for run in _RUN.findall(text):
        if run.isascii():
            out.append(run.lower())
        else:
            out += _of_run(run)
    return out


class Item:
    """An evaluation item: its words, and how many of them are a case."""

    def __init__(self, item_id: int, passage: str | None, query: str | None) -> None:
        self.id = item_id
        self.words = plain_words(passage or "")
        self.query = " ".join(plain_words(query or ""))
        self.half = (len(self.words) + 1) // 2

    def seeds(self, edits: int, count: Counter[str]) -> tuple[int, list[int]]:
        """Words of a seed, and the places of the seeds."""
        n, h = len(self.words), self.half
        size = (h + 1) // (edits + 2)
        if size > 1:
            def weight(offset: int) -> int:
                return sum(min(count[w] for w in self.words[at : at + size]) for at in range(offset, n - size + 1, size))

            return size, list(range(min(range(size), key=weight), n - size + 1, size))
        chosen: set[int] = set()
        need = min(edits + 1, h)
        for at in sorted(range(n), key=lambda i: (count[self.words[i]], i)):
            # needed by some stretch that holds this word and not yet enough others
            if any(sum(k in chosen for k in range(b, b + h)) < need for b in range(max(0, at - h + 1), min(at, n - h) + 1)):
                chosen.add(at)
        return 1, sorted(chosen)


def _reach(a: list[str], b: list[str], edits: int) -> list[tuple[int, int]]:
    """For e = 0..edits, the longest prefix of ``a`` that aligns with a prefix of ``b``.

    Returns ``(words of a, words of b)`` for each number of edits; one edit changes, adds or
    leaves out a word. Both prefixes end with an equal word: an edit at the end of a
    stretch does not lengthen it.
    """
    n, m = len(a), len(b)
    best = [(0, 0)]

    def grow(states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With every state that equal words lead to."""
        out = set(states)
        for i, j in states:
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
                out.add((i, j))
                if (i, j) > best[-1]:
                    best[-1] = (i, j)
        return out

    states = grow({(0, 0)})
    for _ in range(edits):
        best.append(best[-1])
        after = set(states)
        for i, j in states:
            if i < n and j < m:
                after.add((i + 1, j + 1))
            if j < m:
                after.add((i, j + 1))
            if i < n:
                after.add((i + 1, j))
        states = grow(after)
    return best


class Matcher:
    """Finds the leaked items of a text."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], edits: int = EDITS) -> None:
        self.edits = edits
        self.items = [Item(*x) for x in items]
        self.automaton = ahocorasick.Automaton()
        count = Counter(w for item in self.items for w in item.words)
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            if not item.words:
                continue
            size, places = item.seeds(edits, count)
            for at in places:
                where.setdefault(f" {' '.join(item.words[at : at + size])} ", []).append((n, at))
            if item.query:
                where.setdefault(f" {item.query} ", []).append((n, -1))
        for pattern, own in where.items():
            self.automaton.add_word(pattern, (len(pattern), own))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def _stretch(self, item: Item, at: int, text: list[str], place: int) -> tuple[int, int, int] | None:
        """Words of the item in the longest stretch through a run, and its words in the text."""
        right = _reach(item.words[at:], text[place : place + len(item.words) - at + self.edits], self.edits)
        back = text[max(0, place - at - self.edits) : place][::-1]
        left = _reach(item.words[:at][::-1], back, self.edits)
        best = None
        for e in range(self.edits + 1):
            (r, rt), (le, lt) = right[e], left[self.edits - e]
            if best is None or r + le > best[0]:
                best = (r + le, place - lt, place + rt)
        return best if best and best[0] >= item.half else None

    def find(self, text: str) -> list[tuple[int, int, int, float, bool]]:
        """``item id, begin, end, share of the passage, query also stands`` of each leak."""
        if self.empty:
            return []
        own = plain_words(text)
        if not own:
            return []
        line = f" {' '.join(own)} "
        hits = list(self.automaton.iter(line))
        if not hits:
            return []
        index: dict[int, int] = {}
        at = 1
        for k, w in enumerate(own):
            index[at] = k
            at += len(w) + 1
        best: dict[int, tuple[int, int, int]] = {}
        asked: set[int] = set()
        for end, (size, places) in hits:
            k = index[end - size + 2]
            for n, pos in places:
                if pos < 0:
                    asked.add(n)
                    continue
                if n in best and best[n][0] == len(self.items[n].words):
                    continue  # the whole passage stands here
                got = self._stretch(self.items[n], pos, own, k)
                if got and (n not in best or got[0] > best[n][0]):
                    best[n] = got
        if not best:
            return []
        spans = words(text)[1]
        out: dict[int, tuple[int, int, int, float, bool]] = {}
        for n, (got, b, e) in sorted(best.items()):
            item = self.items[n]
            leak = (item.id, spans[b][0], spans[e - 1][1], got / len(item.words), n in asked)
            if item.id not in out or leak[3] > out[item.id][3]:
                out[item.id] = leak
        return list(out.values())


@functools.lru_cache(maxsize=1)
def _part(uri: str, n: int, edits: int) -> Matcher:
    """The automaton of one part of a table in the shared folder."""
    place = re.sub("^file:/+", "/", re.sub("^s3[an]:", "s3:", uri))
    fs, path = pafs.FileSystem.from_uri(place)
    rows = pads.dataset(f"{path}/part={n}", filesystem=fs, format="parquet").to_table().to_pylist()
    return Matcher([(r["i"], r["p"], r["q"]) for r in rows], edits)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
    query_col: str | None = "query",
    edits: int = EDITS,
    part: int = PART,
) -> DataFrame:
    """``<id_col>, <item_col>, begin, end, share, with_query`` of every leak.

    ``begin`` and ``end`` are code points of the original text, ``share`` is the part of
    the passage's words in the stretch. One row per document and item; documents
    given twice are reported once per row. Of passages under one item id the one with
    the largest share counts. Null and empty texts and passages have no row. The documents are read
    once, whatever the number of items; ``part`` bounds the characters of the items of one automaton.
    """
    spark = docs.sparkSession
    query = F.lit(None).cast("string") if query_col is None else F.col(query_col)
    rows = items.select(F.col(item_col).alias("i"), F.col(passage_col).alias("p"), query.alias("q")).filter("p <> ''").distinct()
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text <> ''")
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((src, "_id"), (rows, "i")))
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, begin long, end long, share double, with_query boolean"
    size = rows.agg(F.sum(F.char_length("p") + F.coalesce(F.char_length("q"), F.lit(0)))).first()[0] or 0
    if size <= part:
        listed, uri, filled = [(r.i, r.p, r.q) for r in rows.collect()], "", []
    else:
        listed, uri, parts = None, f"{shared_folder(spark)}/leaks-{uuid.uuid4().hex}", -(-2 * size // part)
        own = F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int").alias("part")
        rows.select("*", own).repartition("part").write.partitionBy("part").parquet(uri)
        filled = sorted(r.part for r in spark.read.parquet(uri).select("part").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None if listed is None else Matcher(listed, edits)

        def scan(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            matchers = (_part(uri, n, edits) for n in filled) if whole is None else (whole,)
            found = [(i, *leak) for matcher in matchers for i, t in zip(ids, texts, strict=True) for leak in matcher.find(t)]
            if found:
                columns = zip(*found, strict=True)
                kinds = (id_kind, None, pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, item_col, "begin", "end", "share", "with_query"])

        ids, texts, held, id_kind = [], [], 0, None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            ids += batch.column(0).to_pylist()
            more = batch.column(1).to_pylist()
            texts += more
            held += sum(map(len, more))
            if listed is not None or held > BLOCK:
                yield from scan(ids, texts)
                ids, texts, held = [], [], 0
        if texts:
            yield from scan(ids, texts)

    return src.mapInArrow(run, schema)


def leaked_items(leaks: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """``<item_col>, n_docs, best_share`` of every item that leaked."""
    return leaks.groupBy(item_col).agg(F.count_distinct(id_col).alias("n_docs"), F.max("share").alias("best_share"))
