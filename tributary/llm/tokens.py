"""Token ids of whole texts by a byte-level BPE, as a bounded-lookahead transducer.

A text is split by the public pre-tokenizer into words, numbers, symbol runs and
white-space runs, which are read one after the other; no token crosses such a split. The
bytes of each go through a ``Transducer``, which emits ids as soon as no later byte can
change them and keeps no more than its lookahead behind the last emitted one. Words are
remembered with their ids, so a word is transduced once per worker while it is remembered.

*One step.* The last token of the encoding of a prefix is the longest token that ends
there and fits the last token of the prefix before it. Two tokens fit if no merge across
their border comes before the merges that use up the parts at the border.

*Lookahead*, computed from the merge list. Let the encodings of a prefix and of a
continuation differ up to some border. The difference moves left over a token A only by a merge
(A, B) that one of the two makes and the other does not, and from there only by a
later merge (A', X) where X begins with A. The heaviest such chain of merges of rising rank,
each weighing the bytes of its left part, bounds how far any later byte reaches back: ids that
end so many bytes before the last one read are final.

Decoding feeds token bytes to an incremental UTF-8 state machine that holds back at
most three bytes.
"""

from __future__ import annotations

import base64
import codecs
import functools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are fed at a time; longer words are not remembered.
PIECE = 64
#: Words remembered by a worker.
REMEMBERED = 1 << 18


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The merge list behind a file of ranks: the two parts of each token, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        #: The token of two parts, and the parts of a token.
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Tokens at the end (begin) of a token, with the token that uses each up, longest first.
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.begins: dict[int, list[tuple[int, int]]] = {}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary has a token for every byte; none for {missing}")
        self.never = max(self.tokens) + 1
        self._fits: dict[tuple[int, int], bool] = {}
        for token in sorted(self.tokens):
            data = self.tokens[token]
            self.ends[token] = self.begins[token] = [(token, self.never)]
            for i in range(1, len(data)):
                a, b = ranks.get(data[:i]), ranks.get(data[i:])
                if a is not None and b is not None and a < token and b < token and self._border(a, b):
                    self.joined[a, b] = token
                    self.parts[token] = a, b
                    self.ends[token] = [(token, self.never), (b, token), *self.ends[b][1:]]
                    self.begins[token] = [(token, self.never), (a, token), *self.begins[a][1:]]
                    break
        #: Lengths of the tokens that end in two bytes, longest first.
        self.sizes: dict[bytes, list[int]] = {}
        for data in sorted(ranks, key=len, reverse=True):
            if len(data) > 1:
                own = self.sizes.setdefault(data[-2:], [])
                if not own or own[-1] != len(data):
                    own.append(len(data))

    def _border(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of two tokens."""
        for x, until_x in self.ends[a]:
            for y, until_y in self.begins[b]:
                rank = self.joined.get((x, y))
                # of equal merges the left one comes first
                if rank is not None and rank < until_x and rank <= until_y:
                    return False
        return True

    def fits(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a`` in an encoding."""
        found = self._fits.get((a, b))
        if found is None:
            if len(self._fits) > 1 << 20:
                self._fits.clear()
            found = self._fits[a, b] = self._border(a, b)
        return found

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes that any later byte reaches back at most; see the module."""
        best: dict[int, int] = {}
        most = 0
        for token in sorted(self.parts, reverse=True):
            a, b = self.parts[token]
            reach = len(self.tokens[a]) + best.get(a, 0)
            most = max(most, reach)
            for y, _ in self.begins[b]:
                if reach > best.get(y, 0):
                    best[y] = reach
        return max(most, 1)


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """The merge list of a file of ranks, built once per worker."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Transducer:
    """Streaming BPE of one unbroken run: ``feed`` bytes, take final ids, ``close``."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self._reset()

    def _reset(self) -> None:
        self._held = b""  # bytes behind the last emitted token
        self._last: list[int] = []  # last token of the encoding of each held prefix
        self._before: int | None = None  # the last emitted token

    @property
    def held(self) -> int:
        return len(self._held)

    def _extend(self, held: bytes, n: int) -> None:
        """Adds the last token of the first ``n`` bytes held."""
        m = self.merges
        for size in m.sizes.get(held[n - 2 : n], ()) if n > 1 else ():
            if size > n:
                continue
            token = m.ranks.get(held[n - size : n])
            if token is None:
                continue
            before = self._last[n - size - 1] if n > size else self._before
            if before is None or m.fits(before, token):
                self._last.append(token)
                return
        self._last.append(m.ranks[held[n - 1 : n]])

    def _ids(self, end: int) -> list[tuple[int, int]]:
        """``end, id`` of the encoding of the first ``end`` bytes held, last first."""
        out = []
        while end > 0:
            token = self._last[end - 1]
            out.append((end, token))
            end -= len(self.merges.tokens[token])
        return out

    def feed(self, data: bytes) -> list[int]:
        """Ids that are final after reading ``data``."""
        begin = len(self._held)
        self._held += data
        for n in range(begin + 1, len(self._held) + 1):
            self._extend(self._held, n)
        final = len(self._held) - self.merges.lookahead
        if final <= 0:
            return []
        done = [(end, i) for end, i in self._ids(len(self._held)) if end <= final]
        if not done:
            return []
        end, self._before = done[0]
        self._held, self._last = self._held[end:], self._last[end:]
        return [i for _, i in reversed(done)]

    def close(self) -> list[int]:
        """The ids that are left; the transducer is ready for another run."""
        out = [i for _, i in reversed(self._ids(len(self._held)))]
        self._reset()
        return out


class StreamingEncoder:
    """Ids of texts of any length; nothing but remembered words, of bounded length and number, outlives a text."""

    def __init__(self, path: str, pattern: str, piece: int = PIECE, remembered: int = REMEMBERED) -> None:
        self.merges = merges(path)
        self.piece, self.remembered = piece, remembered
        self._words = regex.compile(pattern)
        self._transducer = Transducer(self.merges)
        self._known: dict[str, array] = {}
        self.transduced = 0

    def _transduce(self, word: str, out: array) -> None:
        self.transduced += 1
        for i in range(0, len(word), self.piece):
            out.extend(self._transducer.feed(word[i : i + self.piece].encode()))
        out.extend(self._transducer.close())

    def encode_into(self, text: str | None, out: array) -> int:
        """Appends all ids of ``text`` as they become final; of a null or empty text, none. Returns their number."""
        begin, known = len(out), self._known
        for m in self._words.finditer(text) if text else ():
            word = m.group()
            ids = known.get(word)
            if ids is not None:
                out.extend(ids)
            elif len(word) > self.piece:
                self._transduce(word, out)
            else:
                self._transduce(word, ids := array("i"))
                if len(known) >= self.remembered:
                    known.clear()
                known[word] = ids
                out.extend(ids)
        return len(out) - begin

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()


@functools.lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> StreamingEncoder:
    return StreamingEncoder(path, pattern)


class StreamingDecoder:
    """Text of a stream of ids; a character is emitted with its last byte."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("strict")
        for i in ids:
            if text := state.decode(self.tokens[i]):
                yield text
        state.decode(b"", final=True)


def encode_corpus(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``<id_col>, ids array<int>`` of every row, in a map without a shuffle.

    An empty and a null text both give the empty list; strings that look like special
    tokens are ordinary text. A row with a null id keeps it. Rows are independent, so
    repeated ids give repeated rows; other columns are not read. ``path`` is a file of ranks of
    a byte-level vocabulary, ``pattern`` its pre-tokenizer.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            flat, offsets = array("i"), np.zeros(batch.num_rows + 1, dtype=np.int32)
            for n, text in enumerate(batch.column(1)):
                encoder.encode_into(text.as_py(), flat)
                offsets[n + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``<id_col>, text`` of every row of ids; a null list gives a null text."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    src = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamingDecoder(merges(path).tokens)
        for batch in batches:
            texts = [None if x is None else "".join(decoder.decode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, text string")
