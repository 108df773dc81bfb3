"""Long exact spans shared between records, by super-k-mer partitioning.

Every window of ``k`` characters of a text belongs to the bucket of its minimiser, the
smallest of the hashes of its ``m``-character substrings. Consecutive windows with one
minimiser travel as one packed string, a super-k-mer, to that bucket; there the windows are
unpacked, hashed and sorted, so that equal windows lie side by side. Equal windows share
their minimiser, hence their bucket: nothing is missed and no pair of texts is compared
that shares no window.

* Equal texts are one class first; only class representatives are cut into windows.
  Members meet their class again at the end.
* A super-k-mer ends where the minimal hash changes, not where its place does, so a
  periodic text stays one string however long it is.
* A bucket that only one text has is dropped unread. Of the others come the windows at which
  a shared stretch begins (the characters before two equal windows differ, or a text begins
  there), as text, ``id`` and character before: one row per record and stretch. Records
  that share a stretch meet in a join on the window's text, which decides equality.
* A bucket of more than ``hot`` super-k-mers, counted before anything is moved, is split: its
  windows are spread by their own hash and grouped by aggregation, so that neither a bucket
  nor all places of one window need fit in a task. The limit is the same for every corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.plans.storage import cut_lineage

#: Characters of a shared span at least, of a minimiser, and super-k-mers of a bucket that stays whole.
SPAN, MINIMISER, HOT = 200, 24, 50_000
#: Hot buckets, and copies, up to which their list is sent to the workers; more meet the rest in a shuffled join.
LISTED = 100_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_START = 0x110000  # stands for the character before a text's first one
_BATCH_CHARS = 500_000  # places within a batch have 24 bits
_PIECE = 250_000
_BATCH_WINDOWS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Rolling:
    """Hashes of all substrings of one length, by differences of weighted sums."""

    def __init__(self, multiplier: int) -> None:
        self.base = np.uint64(multiplier | 1)
        self.inverse = np.uint64(pow(multiplier | 1, -1, 1 << 64))
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _upto(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                n = max(n, 2 * len(self.powers))
                grown = np.full(n, self.base, np.uint64)
                grown[0] = 1
                self.powers = np.multiply.accumulate(grown)
                grown[1:] = self.inverse
                self.inverses = np.multiply.accumulate(grown)

    def __call__(self, chars: np.ndarray, size: int) -> np.ndarray:
        """Element i hashes chars[i : i + size]; one element fewer for each that misses."""
        n = len(chars)
        if n < size:
            return np.zeros(0, np.uint64)
        self._upto(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(0x51ED27)) * self.powers[:n], out=sums[1:])
            return _mix((sums[size:] - sums[:-size]) * self.inverses[: n - size + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _runs(pieces: list[tuple[int, int, int, str]], k: int, m: int, rolling: _Rolling) -> tuple[np.ndarray, ...]:
    """Bucket, first place and last window's place of each super-k-mer, then characters, begins and owners.

    A piece is ``id, start, character before, string``; its windows are those inside it.
    """
    texts = [p[3] for p in pieces]
    chars = _codes(texts)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    doc = np.repeat(np.arange(len(texts)), sizes)[: max(0, len(chars) - k + 1)]
    place = np.arange(len(doc))
    inside = place + k <= (begins + sizes)[doc]
    grams = rolling(chars, m)
    packed = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(packed, k - m + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    place, doc = place[inside], doc[inside]
    buckets = grams[at[place]].view(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (buckets[1:] != buckets[:-1]) | (doc[1:] != doc[:-1])))[: len(place)])
    lasts = np.concatenate((edge[1:] - 1, [len(place) - 1]))[: len(edge)]
    return buckets[edge], place[edge], place[lasts], chars, begins, doc[edge]


def _superkmers(pieces: list[tuple[int, int, int, str]], k: int, m: int, rolling: _Rolling) -> tuple[list, ...]:
    """Bucket, id, start, character before, and string of each super-k-mer."""
    buckets, starts, lasts, chars, begins, owner = _runs(pieces, k, m, rolling)
    local = starts - begins[owner]
    before = chars[np.maximum(starts - 1, 0)].astype(np.int64)
    before = np.where(local == 0, np.array([p[2] for p in pieces], np.int64)[owner], before)
    owners = [pieces[d] for d in owner.tolist()]
    ends = local + (lasts - starts) + k
    strings = [o[3][s:e] for o, s, e in zip(owners, local.tolist(), ends.tolist(), strict=True)]
    begun = [o[1] + s for o, s in zip(owners, local.tolist(), strict=True)]
    return buckets.tolist(), [o[0] for o in owners], begun, before.tolist(), strings


_PACKED = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("before", pa.int32()), ("part", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """Texts in pieces that overlap by a window less one character, in blocks of bounded size."""
    pieces: list[tuple[int, int, int, str]] = []
    size = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for at in range(0, len(text) - k + 1, _PIECE):
                part = text[at : at + _PIECE + k - 1]
                if size + len(part) > _BATCH_CHARS and pieces:
                    yield pieces
                    pieces, size = [], 0
                pieces.append((i, at, ord(text[at - 1]) if at else _START, part))
                size += len(part)
    if pieces:
        yield pieces


def _pack(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling(_MULTIPLIERS[0])
        for pieces in _pieces(batches, k):
            columns = _superkmers(pieces, k, m, rolling)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)

    return run


def _count_buckets(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling(_MULTIPLIERS[0])
        for pieces in _pieces(batches, k):
            own, n = np.unique(_runs(pieces, k, m, rolling)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["bucket", "n"])

    return run


def _windows(ids: np.ndarray, starts: np.ndarray, before: np.ndarray, parts: list[str], k: int, rolling: tuple[_Rolling, ...]) -> tuple[np.ndarray, ...]:
    """Id, start, character before, number of the super-k-mer and place in it, and the hashes of every window."""
    chars = _codes(parts)
    sizes = np.array([len(p) for p in parts])
    counts = sizes - k + 1
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    part = np.repeat(np.arange(len(parts)), counts)
    inner = np.arange(len(part)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    place = begins[part] + inner
    earlier = chars[np.maximum(place - 1, 0)].astype(np.int64)
    earlier = np.where(inner == 0, before[part], earlier)
    return ids[part], starts[part] + inner, earlier, part, inner, *(r(chars, k)[place] for r in rolling)


def _equal_windows(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal windows side by side, and the start of each group."""
    order = np.argsort(hashes[0]) if len(hashes) == 1 else np.lexsort(hashes)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for h in hashes:
        h = h[order]
        new[1:] |= h[1:] != h[:-1]
    return order, np.flatnonzero(new)


def _beginnings(one: np.ndarray, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Windows at which a stretch begins that several texts share, one for each text and character before.

    Windows are told apart by one hash: if two different ones agree in it, both come out,
    which does no harm, as the join compares their texts.
    """
    order, heads = _equal_windows(one)
    i, b = ids[order], before[order]
    size = np.diff(np.concatenate((heads, [len(order)])))
    low, high = np.minimum.reduceat(b, heads), np.maximum.reduceat(b, heads)
    some = (np.minimum.reduceat(i, heads) != np.maximum.reduceat(i, heads)) & ((low != high) | (high == _START))
    hit = np.flatnonzero(np.repeat(some, size))
    group = np.repeat(np.arange(len(heads)), size)[hit]
    by = np.lexsort((b[hit], i[hit], group))
    hit, group = hit[by], group[by]
    new = np.ones(len(hit), bool)
    new[1:] = (group[1:] != group[:-1]) | (i[hit][1:] != i[hit][:-1]) | (b[hit][1:] != b[hit][:-1])
    return order[hit[new]]


def _shared(one: np.ndarray, two: np.ndarray, ids: np.ndarray, starts: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``id, begin, end`` of the runs of windows that stand in two texts at least."""
    order, heads = _equal_windows(one, two)
    own = ids[order]
    several = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
    hit = order[np.repeat(several, np.diff(np.concatenate((heads, [len(order)]))))]
    if not len(hit):
        return []
    i, s = ids[hit], starts[hit]
    by = np.lexsort((s, i))
    i, s = i[by], s[by]
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (s[1:] - s[:-1] > 1)))
    h = np.flatnonzero(new)
    t = np.concatenate((h[1:] - 1, [len(i) - 1]))
    return list(zip(i[h].tolist(), s[h].tolist(), (s[t] + k).tolist(), strict=True))


_STARTS = pa.schema([("w", pa.string()), ("id", pa.int64()), ("before", pa.int64())])
_RANGES = pa.schema([("id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _bucket_runs(k: int, ranges: bool):
    """Reads super-k-mers sorted by bucket; the windows of whole buckets are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = tuple(map(_Rolling, _MULTIPLIERS[: 1 + ranges]))
        held: list[pa.RecordBatch] = []
        size = 0

        def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows)
            get = lambda c: t.column(c).to_numpy().astype(np.int64)
            bucket, owner = get("bucket"), get("id")
            heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
            kept = np.flatnonzero(np.repeat(several, np.diff(np.concatenate((heads, [len(bucket)])))))
            if not len(kept):
                return
            t = t.take(pa.array(kept))
            parts = t.column("part").to_pylist()
            ids, starts, before, part, inner, *hashes = _windows(get("id"), get("start"), get("before"), parts, k, rolling)
            if ranges:
                if rows := _shared(*hashes, ids, starts, k):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_RANGES)
                return
            hit = _beginnings(*hashes, ids, before)
            if len(hit):
                texts = [parts[p][x : x + k] for p, x in zip(part[hit].tolist(), inner[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(ids[hit]), pa.array(before[hit])], schema=_STARTS)

        for batch in batches:
            b = batch.column(0).to_numpy()
            if not len(b):
                continue
            # the last bucket of a batch may go on in the next
            cut = int(np.flatnonzero(b != b[-1])[-1]) + 1 if b[0] != b[-1] else 0
            if held and (cut or held[-1].column(0)[-1].as_py() != b[0]):
                if size > _BATCH_WINDOWS:
                    own = cut if held[-1].column(0)[-1].as_py() == b[0] else 0
                    head = int(np.flatnonzero(b == b[0])[-1]) + 1 if own else 0
                    if head:
                        held.append(batch.slice(0, head))
                        batch = batch.slice(head)
                    yield from work(held)
                    held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += pc.sum(pc.utf8_length(batch.column(4))).as_py() - (k - 1) * batch.num_rows
        if held:
            yield from work(held)

    return run


_WINDOWS = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("before", pa.int64())])


def _unpack(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = tuple(map(_Rolling, _MULTIPLIERS))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                get = lambda c: part.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
                ids, starts, before, _, _, one, two = _windows(get("id"), get("start"), get("before"), part.column("part").to_pylist(), k, rolling)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), ids, starts, before)], schema=_WINDOWS)

    return run


def _classes(df: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Long texts by id with a 128-bit digest, and the smallest id of each class of equal texts."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= k))
    members = rows.select("id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit("tributary"), "text").alias("y"))
    firsts = members.groupBy("x", "y").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"))
    return rows, members.join(firsts, ["x", "y"]).select("id", "rep", "n")


def _spans(df: DataFrame, id_col: str, text_col: str, k: int, m: int, hot: int, ranges: bool) -> tuple[DataFrame, DataFrame]:
    """Beginnings of shared stretches (or the shared ranges) of class representatives, and the classes."""
    rows, classes = _classes(df, id_col, text_col, k)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = cut_lineage(classes)
    copies = classes.filter("id <> rep").select("id").distinct()
    # few copies are left out where the texts lie; the texts move only to be compared with many
    texts = rows.join(F.broadcast(copies) if copies.count() <= LISTED else copies, "id", "left_anti")
    packed = texts.mapInArrow(_pack(k, m), "bucket long, id long, start long, before int, part string")
    counts = rows.mapInArrow(_count_buckets(k, m), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    large = cut_lineage(counts.filter(F.col("n") > hot).select("bucket"))
    n_large = large.count()
    if not n_large:
        cold = packed
    elif n_large <= LISTED:
        listed = [r.bucket for r in large.collect()]
        cold, split = packed.filter(~F.col("bucket").isin(listed)), packed.filter(F.col("bucket").isin(listed))
    else:
        cold, split = packed.join(large, "bucket", "left_anti"), packed.join(large, "bucket", "left_semi")
    kind = "id long, begin long, end long" if ranges else "w string, id long, before long"
    out = cold.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_runs(k, ranges), kind)
    if n_large:
        single = split.mapInArrow(_unpack(k), "one long, two long, id long, start long, before long")
        groups = single.groupBy("one", "two").agg(*(f(c).alias(f"{n}_{c}") for c in ("id", "before") for n, f in (("low", F.min), ("high", F.max))))
        groups = groups.filter("low_id <> high_id")
        if not ranges:
            groups = groups.filter(f"low_before <> high_before or high_before = {_START}")
        kept = single.join(groups.select("one", "two"), ["one", "two"])
        if ranges:
            out = out.unionAll(kept.select("id", F.col("start").alias("begin"), F.col("start") + k))
        else:
            window = F.substring("text", F.col("start").cast("int") + 1, F.lit(k))
            out = out.unionAll(kept.join(texts, "id").select(window.alias("w"), "id", "before").distinct())
    return out, classes


def members(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``<id_col>, class_id, n``: the class of equal texts of each record of at least ``span`` characters.

    ``class_id`` is the smallest id of the class, ``n`` the number of its records.
    """
    _, classes = _classes(df, id_col, text_col, span)
    return classes.distinct().select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), "n")


def _class_pairs(out: DataFrame) -> DataFrame:
    """Pairs of representatives that have a shared stretch, by a join on its first window."""
    x, y = out.alias("x"), out.alias("y")
    differ = (F.col("x.before") != F.col("y.before")) | (F.col("x.before") == _START)
    pairs = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.id") < F.col("y.id")) & differ)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def class_pairs(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, minimiser: int = MINIMISER, hot: int = HOT
) -> DataFrame:
    """``class_a, class_b``: each pair of classes of ``members`` whose texts share ``span`` characters.

    With ``members`` this says all that ``shared_pairs`` says, without a row for each pair of copies.
    """
    out, _ = _spans(df, id_col, text_col, span, minimiser, hot, ranges=False)
    return _class_pairs(cut_lineage(out)).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def shared_pairs(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, minimiser: int = MINIMISER, hot: int = HOT
) -> DataFrame:
    """``<id_col>_a, <id_col>_b``: each pair of records whose texts share ``span`` characters.

    a < b, each pair once. Null texts, texts shorter than ``span`` and null ids have no
    pair; a row given twice is one record. Copies count, so the result also has the pairs
    inside each class of equal texts, as its definition asks; it is the pairs of ``class_pairs``
    and the classes of ``members`` written out. Other columns are not read.
    """
    out, classes = _spans(df, id_col, text_col, span, minimiser, hot, ranges=False)
    known = classes.select("id", "rep").distinct()
    several = classes.filter("n > 1").select("id", "rep").distinct()
    left = _class_pairs(cut_lineage(out)).join(known.select(F.col("id").alias("ia"), F.col("rep").alias("a")), "a")
    across = left.join(known.select(F.col("id").alias("ib"), F.col("rep").alias("b")), "b").select("ia", "ib")
    x, y = several.alias("x"), several.alias("y")
    inside = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("ia"), F.col("y.id").alias("ib"))
    both = across.unionAll(inside)
    return both.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b"))


def shared_share(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, minimiser: int = MINIMISER, hot: int = HOT
) -> DataFrame:
    """``<id_col>, shared_chars, share`` of every record with a shared span.

    ``shared_chars`` counts the characters that lie in a stretch of at least ``span``
    that also stands in another record; ``share`` is their part of the text.
    Members of a class of equal texts are shared as a whole.
    """
    out, classes = _spans(df, id_col, text_col, span, minimiser, hot, ranges=True)
    size = df.select(F.col(id_col).cast("long").alias("id"), F.length(text_col).cast("long").alias("n_chars")).dropDuplicates(["id"])
    order = Window.partitionBy("id").orderBy("begin", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = out.withColumn("from", F.greatest("begin", F.coalesce(ahead, F.lit(0).cast("long"))))
    merged = merged.groupBy("id").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0).cast("long"))).alias("part"))
    known = classes.distinct().join(merged.withColumnRenamed("id", "rep"), "rep", "left").join(size, "id")
    chars = F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.col("part"))
    result = known.select(F.col("id").alias(id_col), chars.alias("shared_chars"), (chars / F.col("n_chars")).alias("share"))
    return result.filter("shared_chars > 0")
