"""Values that lost their end: a vocabulary trie with length evidence, and marks, sentence ends and contexts beside it.

Evidence that a value stops before the end of its text, in the order in which it is given as the reason:

* *word*, by the trie: the last word, behind which a mark may stand, is unknown and a proper
  prefix of known words of the corpus;
* *length*: a source whose values pile up at one length (in characters or bytes) cuts
  there. Values of exactly that length are cut unless their last word is one that
  nothing ever follows, or they end like a sentence in a field of sentences;
* *mark*: an ellipsis, a broken tag or entity, an opening bracket or quotation mark, a
  dash or comma at the end, a word like "[more]", a lone replacement character;
* *sentence*: in a field of which most values end like sentences (full stop, question or
  exclamation mark, then at most quotation marks or a note such as a date, a reading
  time, a tag or a bracketed number), the value does not end so;
* *context*: the corpus hardly ever ends after the last words. Words are counted with
  the one before them, and with the first word of the value, at the end and elsewhere.

In fields of sentences a value that ends like one is whole, unless its last word is an
abbreviation after which the corpus goes on.

Counts are made over all values. The most frequent words and contexts are sent to the workers, at most
``ENTRIES`` of them, whatever the corpus. Values that rarer ones could decide
are judged a second time, with what a join of their last words with all counts gives. The table is
read three times: lengths, words (with the training sample for garbled text), judgement.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm import encodings
from tributary.plans.storage import cut_lineage

#: Words and contexts that are sent to the workers at most.
ENTRIES = 300_000
#: A length is a cut length if it holds this share of a source's values and stands out
#: this many times from the lengths around it; shorter ones than ``SHORT`` are none.
PEAK_SHARE, PEAK_RATIO, SHORT = 0.01, 4.0, 20
#: A context after which values end more rarely than this, of so many, is none to end with.
RARE_END, SUPPORT = 0.02, 30
#: Share of values with a sentence end from which a field is one of sentences.
SENTENCES = 0.5

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿︎️]")
_NOTE = re.compile(r"\s*(?:\[\d+\]|\(\d+\)|#\d+|[—–-]\s*\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|·\s*\d+\s*\w{1,4}\.?)$")
_STOP = re.compile("[.!?。！？][\"'”’»)）」』\\]]*$")
_MARK = re.compile(
    "(?:\\.{3}|…)[\"'”’»)\\]]*$"  # an ellipsis
    "|<[a-zA-Z/!][^<>]*$|&#?[a-zA-Z0-9]{1,8};?$|&$"  # a broken tag or entity
    "|[(\\[{<„«¿¡‘`–—,;:|/&+=*-]$|(?:^|\\s)[“‘\"']$"  # an opening, joining or parting sign
    "|[\\[(](?!\\d)\\w+[\\])]?$|[>›»→]{2}$|�$"  # a word in brackets that may lead on, arrows, a broken character
)
#: Characters that a mark ending in a letter or digit begins with.
_OPEN = re.compile(r"[<&\[(]")
#: Words in brackets at the end that belong to a title, as "(Vasda)" does, start with a capital.
_NAME = re.compile(r"[(（][A-ZÀ-ÝА-Я]\w*[)）]$")
_TAG = re.compile("<[a-zA-Z/!][^<>]*$")
_MORE = re.compile("(?:[\\[(](?!\\d)\\w+[\\])]?|[>›»→]{2})$")
_DOTS = re.compile("(?:\\.{3}|…)[\"'”’»)\\]]*$")
#: Characters at the end in which marks, notes and sentence ends are looked for.
_TAIL = 48
_TOKEN = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*|[^\w\s]+")
_HAN = re.compile("[㐀-鿿]")


def trimmed(value: str) -> str:
    """Without invisible characters and white space at the end, accents composed."""
    if not value.isascii():
        value = unicodedata.normalize("NFC", _INVISIBLE.sub("", value))
    return value.rstrip()


def marked(end: str) -> bool:
    """Whether the end of a value bears a mark of a cut; a broken tag may begin anywhere."""
    if (at := end.rfind("<")) >= 0 and _TAG.match(end, at):
        return True
    tail = end[-_TAIL:]
    return not (tail[-1].isalnum() and not _OPEN.search(tail)) and _MARK.search(tail) is not None


def unmarked(end: str) -> str:
    """Without an ellipsis, a word in brackets or arrows at the end."""
    return _DOTS.sub("", _MORE.sub("", end).rstrip()).rstrip()


def tokens(value: str) -> list[str]:
    """Words and signs; each Chinese character is one."""
    out: list[str] = []
    for t in _TOKEN.findall(value):
        out += list(t) if not t.isascii() and _HAN.search(t) else [t]
    return out


def kind(token: str) -> str:
    """A token as it counts in contexts: numbers are one, and words with a capital are."""
    if token[0].isdigit():
        return "9"
    return "Aa" if token[0].isupper() else token


@dataclass
class Model:
    """Corpus counts; built by ``fit``."""

    sentences: set[str]
    limits: dict[tuple[str, str | None], list[tuple[str, int]]]
    words: dict[str, tuple[int, int]]  # not last, last
    contexts: dict[str, tuple[int, int]]
    garbled: encodings.Model
    trie: ahocorasick.Automaton | None = field(default=None, repr=False)
    begun: dict[str, bool | None] = field(default_factory=dict, repr=False)
    #: Words and contexts have at least so many occurrences; ``counts`` has all, on the driver only.
    floor: int = 2
    counts: DataFrame | None = field(default=None, repr=False)
    #: For one call of ``judge``: counts of rarer words and contexts, and the keys that were not there.
    facts: dict[str, tuple[int, int, int]] = field(default_factory=dict, repr=False)
    missing: set[str] = field(default_factory=set, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "trie": None, "begun": {}, "counts": None, "facts": {}, "missing": set()}

    def _look(self, table: dict[str, tuple[int, int]], key: str, least: int, mark: str = "") -> tuple[int, int]:
        """Occurrences of a word or context; fewer than ``least`` make no difference."""
        found = table.get(key)
        if found is None and self.floor > least:
            if (fact := self.facts.get(mark + key)) is not None:
                return fact[:2]
            self.missing.add(mark + key)
        return found or (0, 0)

    def prefix_of_known(self, word: str) -> bool:
        """Whether a word is unknown, or far rarer than words that go on from it, and begins some."""
        if word not in self.begun or word in self.facts:
            if len(self.begun) > 1 << 17:
                self.begun.clear()
            begun = self._prefix_of_known(word)
            if word in self.facts:
                return bool(begun)
            self.begun[word] = begun
        if self.begun[word] is None:
            self.missing.add(word)
        return bool(self.begun[word])

    def _prefix_of_known(self, word: str) -> bool | None:
        """None if words below the floor can make a difference."""
        if self.trie is None:
            self.trie = ahocorasick.Automaton()
            for w, (inner, last) in self.words.items():
                if inner + last > 1:
                    self.trie.add_word(w, inner + last)
        if not word[-1].isalpha():
            return False

        def begins(inner: int, last: int, longer: int) -> bool:
            return longer > 1 and inner <= max(1, longer // 30) and last <= max(2, longer // 5)

        known = self.words.get(word)
        longer = max((n for w, n in self.trie.items(word) if w != word), default=0) if self.trie.match(word) else 0
        if (fact := self.facts.get(word)) is not None:
            return begins(*(known or fact[:2]), max(longer, fact[2]))
        rare = self.floor - 1
        most = begins(*(known or (0, 0)), longer or rare)
        least = begins(*known, longer) if known else begins(rare, 0, longer) and begins(0, rare, longer)
        return most if most == least or rare < 2 else None

    def ends_rarely(self, toks: list[str]) -> bool:
        """Whether the corpus hardly ever ends after these last words."""
        wide, narrow = contexts_of(toks, len(toks) - 1)
        for key, rare in ((narrow, RARE_END), (wide, RARE_END / 5)):
            inner, last = self._look(self.contexts, key, SUPPORT, "\x00")
            if inner + last >= SUPPORT:
                return last < rare * (inner + last)
        return False

    def nothing_follows(self, toks: list[str]) -> bool:
        """Whether the last word is one that the corpus only has at the end."""
        if not toks[-1][-1].isalpha():
            return False
        inner, last = self._look(self.words, toks[-1], 2)
        return last > 1 and inner * 30 < last and not self.prefix_of_known(toks[-1])

    def at_limit(self, value: str, name: str, source: str | None) -> bool:
        for unit, size in self.limits.get((name, source), ()):
            if size == (len(value) if unit == "chars" else len(value.encode())):
                return True
        return False

    def _judge(self, text: str, name: str, value: str, source: str | None) -> str:
        """Why a value with the text ``text`` is cut, or an empty string."""
        end = trimmed(text)
        if not end:
            return ""
        if name in self.sentences:
            tail = end[-_TAIL:]
            if tail[-1] not in ".!?。！？":
                tail = _NOTE.sub("", tail)
            dots = _DOTS.search(tail) is not None
            if not dots and _STOP.search(tail):
                word = tail.rsplit(None, 1)[-1]
                inner, last = self._look(self.words, word, SUPPORT)
                return "context" if inner >= SUPPORT and last < RARE_END * inner else ""
            return self._of_method(end, name, value, source) or ("mark" if dots or marked(end) else "sentence")
        if self._bears_mark(end, name):
            return self._of_method(end, name, value, source) or "mark"
        toks = tokens(end)
        if not toks:
            return ""
        if self.prefix_of_known(toks[-1]):
            return "word"
        if self.at_limit(value, name, source):
            follows = not self.nothing_follows(toks)
            if self.missing:
                self.ends_rarely(toks)  # names what it looks up
            if follows:
                return "length"
        return "context" if self.ends_rarely(toks) else ""

    def _bears_mark(self, end: str, name: str) -> bool:
        if not end:
            return False
        if name in self.sentences:
            return _DOTS.search(_NOTE.sub("", end[-_TAIL:])) is not None or marked(end)
        return marked(end) and not _NAME.search(end[-_TAIL:])

    def _of_method(self, end: str, name: str, value: str, source: str | None) -> str:
        """Whether trie or length say that a value is cut that other evidence says it of anyway."""
        toks = tokens(unmarked(end)[-_TAIL:])
        if toks and self.prefix_of_known(toks[-1]):
            return "word"
        return "length" if self.at_limit(value, name, source) else ""

    def judge(self, values: list[tuple[str, str, str | None]], facts: dict[str, tuple[int, int, int]] | None = None) -> list[str]:
        """Why each ``value, field, source`` is cut; an empty string for whole ones."""
        return self.judge_known(values, facts)[0]

    def judge_known(
        self, values: list[tuple[str, str, str | None]], facts: dict[str, tuple[int, int, int]] | None = None, judged_garbled: dict[str, tuple] | None = None
    ) -> tuple[list[str], dict[int, list[str]]]:
        """As ``judge``, and for each value that rarer words or contexts could decide, their keys.

        ``judged_garbled`` is what ``encodings.classify`` says of every value beyond ASCII, where that is known.
        """
        self.facts, need, why = facts or {}, {}, []

        def judged(i: int, text: str) -> str:
            v, f, s = values[i]
            reason = self._judge(text, f, v, s)
            if self.missing:
                need[i] = [*need.get(i, ()), *self.missing]
                self.missing.clear()
            return reason

        self.missing.clear()
        why = [judged(i, v[0]) if v[0] else "" for i, v in enumerate(values)]
        # a garbled value is judged by its restored text
        some = [i for i, w in enumerate(why) if (w or i in need) and not values[i][0].isascii()]
        texts = [values[i][0] for i in some]
        found = encodings.classify(texts, self.garbled) if judged_garbled is None else [judged_garbled[t] for t in texts]
        for i, (bad, _, restored) in zip(some, found, strict=True):
            if not bad:
                continue
            text = (values[i][0] if restored is None else restored).rstrip(encodings.REPLACEMENT)
            reason = judged(i, text)
            if why[i] and restored is None and reason in ("word", "sentence"):
                # its words are not those of the text
                v, f, s = values[i]
                why[i] = "length" if self.at_limit(v, f, s) else "mark" if self._bears_mark(trimmed(text), f) else ""
            elif why[i]:
                why[i] = "" if reason == "context" else reason
        self.facts = {}
        return why, need


def contexts_of(toks: list[str], at: int) -> tuple[str, str]:
    """The contexts of a place: the word with the one before it, and with the first word too."""
    wide = f"{kind(toks[at - 1]) if at else '^'} {kind(toks[at])}"
    return wide, f"{toks[0].lower()} {wide}"


def _count_sentences(texts: list[str], inner: Counter, last: Counter) -> None:
    """Adds the words of texts that end like sentences, as they stand between white space."""
    ends = [trimmed(t) for t in texts]
    inner.update(" ".join(ends).split())
    final = Counter(e.rsplit(None, 1)[-1] for e in ends if e)
    inner.subtract(final)
    last.update(final)


def _count_labels(texts: dict[str, int], cut: Callable[[str], bool], inner: Counter, last: Counter) -> None:
    """Adds words and contexts of other texts; the ends of those that are cut don't count."""
    for text, n in texts.items():
        end = trimmed(text)
        toks = tokens(end)
        if not toks:
            continue
        first, before = toks[0].lower(), "^"
        whole = not (marked(end) or cut(text))
        final = len(toks) - 1
        for at, t in enumerate(toks):
            if at == final and not whole:
                break
            own, counter = kind(t), inner if at < final else last
            counter[t] += n
            counter[first, before, own] += n
            before = own


def _count(values: DataFrame, sentences: set[str], limits: dict, least: float, picked: Column, sample: int) -> tuple[dict, dict, int, DataFrame, list[str]]:
    """Counts of words and contexts, inside values and at their ends; the least count of those here, and all; and ``sample`` of the values picked."""
    probe = Model(sentences, limits, {}, {}, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner: Counter = Counter()
        last: Counter = Counter()
        some: set[str] = set()

        def flush() -> pa.RecordBatch:
            for counter in (inner, last):
                for k, n in list(counter.items()):
                    if isinstance(k, tuple):
                        del counter[k]
                        counter["\x00" + " ".join(k)] += n
                        counter["\x00" + " ".join(k[1:])] += n
                    elif (bare := k.strip(".,;:!?\"'“”„«»()[]…")) != k and bare:
                        counter[bare] += n
            keys = [*(inner.keys() | last.keys()), *(f"\x01{v}" for v in some)]
            columns = [pa.array(keys, pa.string()), pa.array([inner[k] for k in keys], pa.int64()), pa.array([last[k] for k in keys], pa.int64())]
            inner.clear()
            last.clear()
            some.clear()
            return pa.RecordBatch.from_arrays(columns, names=["k", "inner", "last"])

        for batch in batches:
            by: dict[tuple[str, str | None], list[str]] = {}
            for name, source, value, pick in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault((name, source), []).append(value)
                if pick:
                    some.add(value)
            for (name, source), texts in by.items():
                if name in sentences:
                    _count_sentences(texts, inner, last)
                else:
                    _count_labels(Counter(texts), lambda v, n=name, s=source: probe.at_limit(v, n, s), inner, last)
            if len(inner) + len(last) > 1_000_000:
                yield flush()
        yield flush()

    counts = values.select("field", "source", "value", picked).mapInArrow(run, "k string, inner long, last long")
    counts = cut_lineage(counts.groupBy("k").agg(F.sum("inner").alias("inner"), F.sum("last").alias("last")))
    value = F.expr("substring(k, 2)")
    chosen = counts.filter(F.col("k").startswith("\x01")).select(value.alias("value")).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
    counts = counts.filter(~F.col("k").startswith("\x01"))
    # of the powers of two, the least count that few enough reach
    n, powers = F.col("inner") + F.col("last"), range(1, 62)
    total, *reached = counts.agg(F.sum(n), *(F.count_if(n >= F.lit(1 << i)) for i in powers)).first()
    floor = max(next(1 << i for i, r in zip(powers, reached, strict=True) if r <= ENTRIES or i == powers[-1]), math.ceil(least * (total or 0)))
    words: dict[str, tuple[int, int]] = {}
    contexts: dict[str, tuple[int, int]] = {}
    for batch in counts.filter(F.col("inner") + F.col("last") >= floor).toArrow().to_batches(10_000):
        for k, *own in zip(*(batch.column(c).to_pylist() for c in ("k", "inner", "last")), strict=True):
            if k[:1] == "\x00":
                contexts[k[1:]] = tuple(own)
            elif k:
                words[k] = tuple(own)
    return words, contexts, floor, counts, [r.value for r in chosen]


def with_facts(unsettled: DataFrame, model: Model) -> DataFrame:
    """Rows of a checkpoint with ``facts``: for each key in ``need`` its counts, and the largest of words below the floor that go on from it."""
    rows = unsettled.withColumn("_u", F.monotonically_increasing_id())
    wanted = rows.select("_u", F.explode(F.array_distinct("need")).alias("k"))
    keys = cut_lineage(wanted.select("k").distinct())
    n = F.col("inner") + F.col("last")
    counts = model.counts.filter(n > 1)
    words = keys.filter(~F.col("k").startswith("\x00")).select(F.col("k").alias("word"), F.char_length("k").alias("size"), F.xxhash64("k").alias("h"))
    sizes = sorted(r["size"] for r in words.select("size").distinct().collect())
    rare = counts.filter((n < model.floor) & ~F.col("k").startswith("\x00")).select(F.col("k").alias("long"), n.alias("n"))
    cuts = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda size: size < F.char_length("long"))
    begun = rare.select("long", "n", F.explode(cuts).alias("size")).withColumn("h", F.xxhash64(F.expr("substring(long, 1, size)")))
    longer = begun.join(words, ["h", "size"]).filter(F.col("long").startswith(F.col("word"))).groupBy(F.col("word").alias("k")).agg(F.max("n").alias("longer"))
    facts = keys.join(counts, "k", "left").join(longer, "k", "left").fillna(0, ["inner", "last", "longer"])
    found = wanted.join(facts, "k").groupBy("_u").agg(F.collect_list(F.struct("k", "inner", "last", "longer")).alias("facts"))
    return rows.join(found, "_u").drop("_u", "need")


def facts_of(batch: pa.RecordBatch) -> dict[str, tuple[int, int, int]] | None:
    """What ``with_facts`` found for the values of a batch."""
    if "facts" not in batch.schema.names:
        return None
    return {f["k"]: (f["inner"], f["last"], f["longer"]) for row in batch.column("facts").to_pylist() for f in row}


def _limits(values: DataFrame) -> tuple[set[str], dict, int]:
    """Fields of sentences, the cut lengths of each field and source, and the number of values."""
    ends = F.substring("value", -8, 8).rlike(r"[.!?。！？][\"'”’»)）\]\s\p{Cf}]*$")
    base = values.groupBy("field", "source", F.char_length("value").alias("chars"), F.octet_length("value").alias("bytes")).agg(
        F.count("*").alias("n"), F.sum(ends.cast("long")).alias("ended")
    )
    base = cut_lineage(base)
    shares = base.groupBy("field").agg((F.sum("ended") / F.sum("n")).alias("share"), F.sum("n").alias("n")).collect()
    sentences = {r.field for r in shares if r.share >= SENTENCES}
    sizes = base.selectExpr("field", "source", "n", "stack(2, 'chars', chars, 'bytes', bytes) as (unit, size)")
    sizes = sizes.groupBy("field", "source", "unit", "size").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("field", "source", "unit")
    near = own.orderBy("size").rangeBetween(-3, 3)
    found = (
        sizes.withColumn("share", F.col("n") / F.sum("n").over(own))
        .withColumn("around", (F.sum("n").over(near) - F.col("n")) / 6)
        .filter((F.col("share") >= PEAK_SHARE) & (F.col("size") >= SHORT) & (F.col("n") >= PEAK_RATIO * (F.col("around") + 5)))
        .collect()
    )
    limits: dict[tuple[str, str | None], list[tuple[str, int]]] = {}
    for r in found:
        limits.setdefault((r.field, r.source), []).append((r.unit, r["size"]))
    return sentences, limits, sum(r.n for r in shares)


def _values(df: DataFrame, id_col: str, fields: list[str], source_col: str | None) -> DataFrame:
    source = F.lit(None).cast("string") if source_col is None else F.col(source_col).cast("string")
    parts = ", ".join(f"'{f}', `_f{k}`" for k, f in enumerate(fields))
    rows = df.select(F.col(id_col).alias("_id"), source.alias("source"), *(F.col(f).alias(f"_f{k}") for k, f in enumerate(fields)))
    return rows.selectExpr("_id", "source", f"stack({len(fields)}, {parts}) as (field, value)").filter("value <> ''")


def fit(
    df: DataFrame,
    *,
    fields: tuple[str, ...] = ("title", "content"),
    source_col: str | None = "engine",
    sample: int = encodings.SAMPLE,
    least_share: float = 0.0,
) -> Model:
    """A model of the values of ``fields``; ``sample`` bounds the training sample for garbled text.

    Words and contexts that make up less than ``least_share`` of all stay with the rarer ones even
    where there are few.
    """
    values = _values(df.select(F.lit(0).alias("_none"), *fields, *([source_col] if source_col else [])), "_none", list(fields), source_col)
    sentences, limits, n = _limits(values)
    picked = (encodings.sampled(sample, n) & (F.octet_length("value") > F.char_length("value"))).alias("picked")
    words, contexts, floor, counts, some = _count(values, sentences, limits, least_share, picked, sample)
    return Model(sentences, limits, words, contexts, encodings.train(some), floor=floor, counts=counts)


def find_truncated(
    df: DataFrame,
    *,
    id_col: str = "result_id",
    fields: tuple[str, ...] = ("title", "content"),
    source_col: str | None = "engine",
    model: Model | None = None,
) -> DataFrame:
    """``<id_col>, field, source, reason`` of every cut value.

    ``reason`` is word, length, mark, sentence or context, the first of these that holds. Null and
    empty values are none. A garbled value that its raw text says is cut is judged by its restored
    text, one that can't be restored only by marks and length. Rows are judged by themselves, so repeated ids and rows give
    repeated results; other columns are not read.
    """
    model = model or fit(df, fields=fields, source_col=source_col)
    values = _values(df, id_col, list(fields), source_col)
    kind_ = values.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, names, texts = (batch.column(c).to_pylist() for c in ("source", "field", "value"))
            keys = list(zip(texts, names, sources, strict=True))
            different = list(dict.fromkeys(keys))
            reasons, lacking = model.judge_known(different, facts_of(batch))
            why = dict(zip(different, reasons, strict=True))
            need = {different[i]: k for i, k in lacking.items()}
            hit = [i for i, k in enumerate(keys) if why[k] or k in need]
            at = pa.array(hit, pa.int32())
            columns = [batch.column(c).take(at) for c in ("_id", "field", "source")] + [pa.array([why[keys[i]] for i in hit], pa.string())]
            columns += [pa.array([keys[i][0] if keys[i] in need else None for i in hit], pa.string()), pa.array([need.get(keys[i]) for i in hit], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "field", "source", "reason", "value", "need"])

    kinds = f"_id {kind_}, field string, source string, reason string, value string, need array<string>"
    names = [F.col("_id").alias(id_col), "field", "source", "reason"]
    found = values.mapInArrow(run, kinds)
    if model.floor == 2:
        return found.select(*names)
    found = cut_lineage(found)
    again = with_facts(found.filter("need is not null"), model).select("_id", "source", "field", "value", "facts")
    return found.filter("need is null").select(*names).unionAll(again.mapInArrow(run, kinds).select(*names))


REASONS = ("word", "length", "mark", "sentence", "context")


def report(df: DataFrame, *, fields: tuple[str, ...] = ("title", "content"), source_col: str = "engine") -> DataFrame:
    """``source, field, n, n_cut, share`` over the non-empty values of each source and field, and ``n_<reason>`` of the cut ones."""
    given = df.select(F.lit(0).alias("_none"), source_col, *fields)
    cut = find_truncated(given, id_col="_none", fields=fields, source_col=source_col)
    n = _values(given, "_none", list(fields), source_col).groupBy("source", "field").agg(F.count("*").alias("n"))
    why = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS]
    c = cut.groupBy("source", "field").agg(F.count("*").alias("n_cut"), *why).withColumnsRenamed({"source": "s", "field": "f"})
    both = n.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left").fillna(0, ["n_cut", *(f"n_{r}" for r in REASONS)])
    return both.select("source", "field", "n", "n_cut", (F.col("n_cut") / F.col("n")).alias("share"), *(f"n_{r}" for r in REASONS))
