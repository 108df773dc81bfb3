"""Text decoded with the wrong character encoding: find it and restore it.

A multinomial classifier on hashed byte bigrams tells clean text from text garbled by each
*chain* (bytes written in one encoding, read in another, once or twice). It is trained on
a bounded sample of the values themselves: the sample as it stands is the clean class,
and synthetically garbled copies of it are the others. A second round leaves out of the
sample what the first round flagged.

A value's evidence for a chain is the largest sum, over a contiguous stretch of its
bigrams, of the log-likelihood ratio of chain and clean text, so that a garbled part counts
however much clean text surrounds it. The chain predicted is inverted: within the value
the characters are turned back into bytes and only sequences that decode strictly are
replaced. A value is garbled if the inversion changes it, or if evidence remains that
no inversion explains (bytes were lost, so it can't be restored).
"""

from __future__ import annotations

import codecs
import functools
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in the training sample, buckets of the bigram hash.
SAMPLE, BUCKETS = 5_000, 1 << 15
#: Evidence (in nats) from which an inversion is tried, and from which a value that no
#: inversion changes counts as garbled.
TRY, LOST = 10.0, 60.0
#: Evidence that a run of two-byte characters needs by itself.
_PAIR_EVIDENCE = 16.0
#: Evidence that a value read in another one-byte encoding needs.
_ONE_BYTE = 11.0
#: Chains that are tried on a value, the likeliest first, until one explains something.
NEXT = 3
REPLACEMENT = "�"

#: Fixed values: (written in, read in) of the steps, public encoding names.
STEPS = (
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp1251"),
    ("utf-8", "koi8-r"),
    ("utf-8", "mac-roman"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "cp866"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp1253"),
    ("utf-8", "gb18030"),
    ("cp1251", "cp1252"),
    ("koi8-r", "cp1251"),
    ("gb18030", "cp1252"),
    ("cp1252", "utf-8"),
    ("cp1251", "utf-8"),
    ("gb18030", "utf-8"),
)
#: Steps that may follow one another, in any order.
TWICE = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"))
#: Share of the sample that a chain must garble unlike all chains before it to be told apart from them.
OWN_SHARE = 0.01

Chain = tuple[tuple[str, str], ...]
#: All chains that are tried; training leaves out those that the sample can't tell from others.
CHAINS: tuple[Chain, ...] = tuple((s,) for s in STEPS) + tuple((a, b) for a in TWICE for b in TWICE)


@functools.lru_cache(maxsize=32)
def _single(encoding: str) -> tuple[str, dict[str, int]] | None:
    """The 256 characters of a one-byte encoding; undefined bytes stand for control characters."""
    if encoding in ("utf-8", "gb18030"):
        return None
    chars = [bytes([b]).decode(encoding, "replace") for b in range(256)]
    chars = [chr(b) if c == REPLACEMENT else c for b, c in enumerate(chars)]
    return "".join(chars), {c: b for b, c in enumerate(chars)}


def _encode(text: str, encoding: str) -> bytes:
    one = _single(encoding)
    return text.encode(encoding, "replace") if one is None else codecs.charmap_encode(text, "replace", _bytes_of(encoding))[0]


def _decode(data: bytes, encoding: str) -> str:
    one = _single(encoding)
    return data.decode(encoding, "replace") if one is None else codecs.charmap_decode(data, "strict", one[0])[0]


def garble(text: str, chain: Chain) -> str:
    """``text`` written and read with each step of ``chain``."""
    for written, read in chain:
        text = _decode(_encode(text, written), read)
    return text


#: Well-formed UTF-8 sequences of two to four bytes, on bytes shown as characters.
_SEQUENCE = regex.compile(
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
#: Han, kana, symbols and other characters that UTF-8 read as GB 18030 turns into.
_WIDE = regex.compile("(?:[^\\x00-\\x7f�][a-z]?)+")


@functools.lru_cache(maxsize=32)
def _bytes_of(encoding: str) -> dict[int, int]:
    chars = _single(encoding)[0]
    # what isn't in the encoding becomes U+FFFF, which no sequence holds
    return {ord(c): b for b, c in enumerate(chars)}


class _Map(dict):
    def __missing__(self, key: int) -> int:
        return 0xFFFF


@functools.lru_cache(maxsize=32)
def _to_bytes(encoding: str) -> _Map:
    return _Map(_bytes_of(encoding))


def _undo_wide(text: str) -> str:
    """Inverse of UTF-8 read as GB 18030, for runs that decode strictly.

    The last character of a run may have lost its last bytes, or belong to what follows.
    """

    def back(m: regex.Match) -> str:
        run = m.group()
        for end in range(len(run), max(0, len(run) - 3), -1):
            part = run[:end]
            try:
                return part.encode("gb18030").decode("utf-8") + run[end:]
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return run

    return _WIDE.sub(back, text)


def undo(text: str, chain: Chain, better: Callable[[str, str], bool] = lambda garbled, restored: True) -> str:
    """``text`` with every part that ``chain`` explains put back; the rest as it was.

    Where the bytes were not UTF-8, nearly every run decodes; ``better(run, restored)`` decides.
    Of two different steps both must be found, or nothing is put back.
    """
    given = text
    for written, read in reversed(chain):
        before = text
        if read == "utf-8":
            return text  # bytes were lost
        if read == "gb18030":
            text = _undo_wide(text)
            continue
        view = text.translate(_to_bytes(read))
        parts, at = [], 0
        found = list(_RUNS.get(written, _UPPER).finditer(view))
        for n, m in enumerate(found):
            if written == "utf-8" and read in CYRILLIC:
                # garbling spares no letter of a word: one beside the run that is in no run speaks against it
                first, last = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
                if _CYRILLIC.match(first) and not (n and found[n - 1].end() == m.start()):
                    continue
                if _CYRILLIC.match(last) and not (n + 1 < len(found) and found[n + 1].start() == m.end()):
                    continue
            if written not in _RUNS and _LETTER.search(text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]):
                continue  # a one-byte reading garbles whole words
            try:
                out = m.group().encode("latin-1").decode(written)
            except UnicodeDecodeError:
                continue
            if written not in _RUNS and len(out) == 1 and not any(ord(c) >> 8 == ord(out) >> 8 for c in text):
                continue  # a lone letter in a text that has none of its alphabet
            if better(text[m.start() : m.end()], out):
                parts += [text[at : m.start()], out]
                at = m.end()
        text = "".join(parts) + text[at:]
        if text == before and len(set(chain)) > 1:
            return given
    return text


#: Encodings whose upper half is letters of words.
CYRILLIC = ("cp1251", "koi8-r", "cp866")
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_UPPER = regex.compile("[\x80-\xff]+")
_RUNS = {"utf-8": _SEQUENCE, "gb18030": regex.compile("(?:[\x81-\xfe][\xa1-\xfe])+")}
_LETTER = regex.compile(r"[\p{L}\p{M}\p{Cf}]")


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams with a byte beyond ASCII, and the text of each."""
    data = [t.encode() for t in texts]
    flat = np.frombuffer(b"\x00".join(data) + b"\x00", np.uint8).astype(np.uint32)
    sizes = np.array([len(d) + 1 for d in data])
    a, b = flat[:-1], flat[1:]
    at = np.flatnonzero((a | b) > 127)
    at = at[(a[at] != 0) & (b[at] != 0)]
    owner = np.searchsorted(np.cumsum(sizes), at, side="right")
    code = (a[at] << np.uint32(8)) | b[at]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1), owner


@dataclass
class Model:
    """Log-likelihood ratios of each chain against clean text, by bucket."""

    ratios: np.ndarray
    blocks: frozenset[int]
    chains: tuple[Chain, ...]

    def __post_init__(self) -> None:
        self.peak = self.ratios.max(axis=0)

    def suspects(self, texts: list[str]) -> list[int]:
        """Texts whose evidence for some chain may reach ``TRY``: a bound from the best ratio of each bigram."""
        grams, owner = _bigrams(texts)
        if not len(grams):
            return []
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        drop = np.repeat(np.arange(len(heads)) * 1e6, np.diff(np.concatenate((heads, [len(owner)]))))
        gain = self.peak[grams]
        total = np.cumsum(gain, dtype=np.float64) - drop
        low = np.minimum.accumulate(total - gain)
        return owner[heads[np.maximum.reduceat(total - low, heads) >= TRY]].tolist()

    def accepts(self, chain: int) -> Callable[[str, str], bool]:
        """Whether a run speaks for the chain rather than for clean text, and gives known characters.

        Known are the blocks of 128 code points that the clean sample holds. Well-formed
        UTF-8 hardly arises by chance; other encodings need evidence in the run itself.
        """
        first, read = self.chains[chain][0]
        letters = read in CYRILLIC
        least = {"utf-8": -np.inf, "gb18030": _PAIR_EVIDENCE}.get(first, 0.0)

        def decide(garbled: str, restored: str) -> bool:
            if letters and any(map(unicodedata.combining, restored)):
                return False  # two letters of a word that happen to be an accent's bytes
            if not all(ord(c) >> 7 in self.blocks for c in restored):
                return first == "utf-8" and len(self.chains[chain]) > 1 and all(ord(c) < 0x3000 for c in restored)
            return least == -np.inf or self.ratios[chain][_bigrams([f" {garbled} "])[0]].sum() > least

        return decide

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Best sum over a stretch, for each text and chain."""
        grams, owner = _bigrams(texts)
        out = np.zeros((len(texts), len(self.chains)))
        if not len(grams):
            return out
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        drop = np.repeat(np.arange(len(heads)) * 1e6, np.diff(np.concatenate((heads, [len(owner)]))))
        for c in range(len(self.chains)):
            gain = self.ratios[c][grams]
            total = np.cumsum(gain, dtype=np.float64) - drop
            low = np.minimum.accumulate(total - gain)
            out[owner[heads], c] = np.maximum.reduceat(total - low, heads)
        return out


class _Sample:
    """Bigrams of a sample and of its copies garbled by every chain, worked out once for all rounds of training."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.clean = self._slim(*_bigrams(texts)) if texts else (np.zeros(0, np.uint16), np.zeros(0, np.int32))
        self.blocks = [frozenset(ord(c) >> 7 for c in t) for t in texts]
        #: For each chain bigrams, the text of each, and whether no chain before garbles the text alike.
        self.garbled: dict[Chain, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        known: list[set[int]] = [set() for _ in texts]
        for chain in CHAINS:
            own, of, fresh = [], [], np.zeros(len(texts), bool)
            for n, (text, seen) in enumerate(zip(texts, known, strict=True)):
                g = garble(text, chain)
                if g != text and "???" not in g:
                    own.append(g)
                    of.append(n)
                    fresh[n] = hash(g) not in seen
                    seen.add(hash(g))
            if own:
                grams, owner = _bigrams(own)
                self.garbled[chain] = *self._slim(grams, np.array(of)[owner]), fresh

    @staticmethod
    def _slim(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return grams.astype(np.uint16), owner.astype(np.int32)

    def fit(self, kept: np.ndarray) -> Model:
        """A model of the texts kept, with the chains that garble enough of them unlike all before."""

        def logs(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
            counts = np.bincount(grams[kept[owner]], minlength=BUCKETS)
            smooth = 0.05
            return np.log((counts + smooth) / (counts.sum() + smooth * BUCKETS))

        base = logs(*self.clean)
        blocks = frozenset({0}).union(*(b for b, k in zip(self.blocks, kept.tolist(), strict=True) if k))
        found = {c: logs(grams, owner) for c, (grams, owner, fresh) in self.garbled.items() if fresh[kept].sum() > OWN_SHARE * kept.sum()}
        found = found or {CHAINS[0]: base}
        return Model(np.stack([np.clip(x - base, -8, 8) for x in found.values()]).astype(np.float32), blocks, tuple(found))


def train(values: list[str]) -> Model:
    """A model of a sample of mostly clean values."""
    sample = _Sample(sorted({v for v in values if v and not v.isascii() and REPLACEMENT not in v and not regex.search(r"[\x80-\x9f]", v)}))
    kept = np.ones(len(sample.texts), bool)
    model = sample.fit(kept)
    for _ in range(2):
        some = np.flatnonzero(kept)
        kept[some] = [not f for f, *_ in classify([sample.texts[i] for i in some], model)]
        model = sample.fit(kept)
    return model


def classify(texts: list[str], model: Model) -> list[tuple[bool, str, str | None]]:
    """``garbled, chain, restored`` of each text; restored is null where nothing could be put back.

    A single replacement character at the end is left out of account: it marks a cut.
    """
    views = [t[:-1] if t.endswith(REPLACEMENT) and t.count(REPLACEMENT) == 1 else t for t in texts]
    out: list[tuple[bool, str, str | None]] = [(REPLACEMENT in v, "lost" if REPLACEMENT in v else "", None) for v in views]
    some = model.suspects(views)
    tops = np.zeros((len(views), len(model.chains)))
    tops[some] = model.evidence([views[i] for i in some])
    tries = np.flatnonzero(tops.max(axis=1) >= TRY).tolist()
    fixed, by = [], []
    for i in tries:
        # the likeliest chain; where it explains nothing, the next ones
        order = [c for c in np.argsort(-tops[i], kind="stable")[:NEXT].tolist() if tops[i, c] >= TRY]
        f, chain = views[i], order[0]
        for c in order:
            if (f := undo(views[i], model.chains[c], model.accepts(c))) != views[i]:
                chain = c
                break
        fixed.append(f)
        by.append(chain)
    left = model.evidence(fixed).max(axis=1)
    for i, f, chain, rest in zip(tries, fixed, by, left, strict=True):
        name = "; ".join(f"{w} read as {r}" for w, r in model.chains[chain])
        one_byte = model.chains[chain][0][0] not in ("utf-8", "gb18030")
        best = tops[i].max()
        if f != views[i] and rest < best and tops[i, chain] >= (_ONE_BYTE if one_byte else TRY):
            out[i] = (True, name, f + texts[i][len(views[i]) :])
        elif best >= LOST:
            out[i] = (True, name, None)
    return out


def long_form(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``_id, field, value`` for every non-empty value of ``fields``."""
    parts = ", ".join(f"'{f}', `{f}`" for f in fields)
    rows = df.select(F.col(id_col).alias("_id"), *(F.col(f) for f in fields))
    return rows.selectExpr("_id", f"stack({len(fields)}, {parts}) as (field, value)").filter("value <> ''")


def beyond_ascii(values: DataFrame) -> DataFrame:
    """The rows whose value holds a character beyond ASCII; no other value can be garbled."""
    return values.filter(F.octet_length("value") > F.char_length("value"))


def sample_values(values: DataFrame, size: int, rows: int) -> list[str]:
    """At most ``size`` distinct values, those with the smallest hashes.

    ``rows`` is the number of values, near enough; it sets the part of the hash range
    that is collected from, so that a value repeated without end counts once.
    """
    hashed = values.filter(sampled(size, rows)).select("value", F.xxhash64("value").alias("h"))
    return [r.value for r in hashed.distinct().orderBy("h", "value").limit(size).collect()]


def sampled(size: int, rows: int) -> Column:
    """Whether ``value`` is in the part of the hash range that a sample of ``size`` is taken from."""
    part = min(1.0, 8 * size / max(rows, 1))
    return F.lit(True) if part == 1 else F.xxhash64("value") <= F.lit(int(-(1 << 63) + part * ((1 << 64) - 1)))


def train_on(df: DataFrame, *, fields: list[str], sample: int = SAMPLE) -> Model:
    """A model of the values of ``fields``; empty tables give one that finds nothing but lost bytes."""
    rows = df.count() * len(fields)
    values = beyond_ascii(long_form(df.select(F.lit(0).alias("_none"), *fields), "_none", fields))
    return train(sample_values(values, sample, rows))


def find_garbled(df: DataFrame, *, id_col: str = "result_id", fields: tuple[str, ...] = ("title", "content"), sample: int = SAMPLE) -> DataFrame:
    """``<id_col>, field, chain, restored`` of every garbled value.

    ``restored`` is null where nothing could be put back, ``chain`` names the encodings.
    Null, empty and pure ASCII values are not garbled; a single replacement character at
    the end is a cut, not garbling. Each row is judged by itself, so repeated ids and
    rows give repeated results; other columns are not read. ``sample`` bounds the
    training sample; every value is classified.
    """
    names = list(fields)
    model = train_on(df, fields=names, sample=sample)
    values = beyond_ascii(long_form(df, id_col, names))
    kind = values.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            different = list(dict.fromkeys(texts))
            judged = {t: r for t, r in zip(different, classify(different, model), strict=True) if r[0]}
            hit = [i for i, t in enumerate(texts) if t in judged]
            chain = pa.array([judged[texts[i]][1] for i in hit], pa.string())
            restored = pa.array([judged[texts[i]][2] for i in hit], pa.string())
            at = pa.array(hit, pa.int32())
            columns = [batch.column(0).take(at), batch.column(1).take(at), chain, restored]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "field", "chain", "restored"])

    return values.mapInArrow(run, f"`{id_col}` {kind}, field string, chain string, restored string")
