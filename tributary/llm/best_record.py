"""The best representative of each group of duplicate records, field by field.

Rows whose urls name one page form a group. For each field the distinct values of a group
are brought together by *token-level consensus*: the heaviest value is the backbone of the
profile, all others are aligned to it (longest common subsequence of tokens) and vote with
their weight for a token, or a gap, in each column, and for what they insert between two
columns. The consensus has the heaviest token of each column, and the existing value
closest to it is emitted.

Only whole values vote: not empty, no stand-in for a missing text, not cut off, not
garbled. A value's weight is ``WEIGHT / (1 + k * beaten)``, rounded down, where ``beaten``
adds up how many values of the group have more characters, how many were seen later and how many
come with more trust, and ``k`` is the number of values. A value that nothing beats outweighs all
others together, so it wins every column; otherwise the votes blend.

Every value is aligned to the backbone alone and votes are integers, so neither order nor
blocks of values change the result. Equal values of a group are pre-aggregated before
anything else. Up to ``block`` distinct values of a field are aligned in one task; for
larger groups alignments are spread over tasks and the votes are summed by
column and token: the same result. Nothing brings such a group into one task: values that
another continues are found on ranges of the sorted texts, and ranks by counting.

A stand-in is a text that is on the list below, or one that stands on ``STAND_IN_PAGES``
pages or more and, on most of those that have another text, shares less than half of the words
(of the shorter one) with the longest of these.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm import encodings, truncation
from tributary.llm.format_duplicates import url_form
from tributary.operators.rank import range_positions
from tributary.plans.storage import cut_lineage

#: Distinct values of a field that one task aligns; the result does not depend on it.
BLOCK = 256
#: The weight of a value that nothing beats.
WEIGHT = 1 << 32
#: Pages that a text must stand on to be tested for a stand-in.
STAND_IN_PAGES = 5
#: Bytes of a table that is broadcast, at 64 a row and those of its texts; a larger one is shuffled.
SMALL_TABLE = 32 << 20
#: Rows of the registry up to which weights are looked up in a literal map.
SMALL_REGISTRY = 1_000
#: Usual stand-ins for a missing text, in lower case.
STAND_INS = frozenset({"-", "–", "—", "...", "n/a", "none", "null", "untitled", "(no title)", "no title", "loading", "loading...", "error 404", "404 not found"})

_SPLIT = re.compile(r"\s+|[㐀-鿿]|[^\w\s]|[^\W㐀-鿿]+")
_SITE = re.compile(r"\s*(?:-|–|—|\||::|·)\s*\S+(?:\s\S+)?\s*$")


def split(value: str) -> list[str]:
    """Tokens of a value that give it when joined: words, signs, white space, Chinese characters."""
    return _SPLIT.findall(value)


def _rows(a: list[str], b: list[str]) -> list[int]:
    """For each prefix of ``b`` a bit vector over ``a``: a zero is where the longest common subsequence grows."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, []
    for t in b:
        u = v & places.get(t, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of ``a`` and ``b`` that a longest common subsequence brings together."""
    rows = _rows(a, b)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _middle(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many tokens are equal at the begin, and at the end of the rest."""
    most = min(len(a), len(b))
    begin = next((n for n in range(most) if a[n] != b[n]), most)
    end = next((n for n in range(most - begin) if a[-1 - n] != b[-1 - n]), most - begin)
    return begin, end


#: The place of a column within its slot, behind all that is inserted before it.
_COLUMN = 0xFFFFFFFF


def votes_against(backbone: list[str], value: list[str]) -> list[tuple[int, str]]:
    """``slot, token`` wherever an aligned value differs from the backbone.

    Column ``i`` of the backbone is slot ``i << 32 | _COLUMN``; the n-th token inserted before it
    is ``i << 32 | n``. An empty token is a gap. Between two matches tokens are paired one to
    one; what is left over is inserted, or a gap.
    """
    begin, end = _middle(backbone, value)
    a, b = backbone[begin : len(backbone) - end], value[begin : len(value) - end]
    out: list[tuple[int, str]] = []
    i = j = 0
    for k, m in [*(_matches(a, b) if a and b else ()), (len(a), len(b))]:
        both = min(k - i, m - j)
        for n in range(both):
            out.append(((begin + i + n) << 32 | _COLUMN, b[j + n]))
        for n in range(i + both, k):
            out.append(((begin + n) << 32 | _COLUMN, ""))
        for n in range(j + both, m):
            out.append(((begin + k) << 32 | (n - j - both), b[n]))
        i, j = k + 1, m + 1
    return out


def rebuilt(backbone: list[str], changes: dict[int, str]) -> str:
    """The backbone with other tokens in some slots."""
    slots = {i << 32 | _COLUMN: t for i, t in enumerate(backbone)} | changes
    return "".join(slots[k] for k in sorted(slots))


def consensus(values: list[tuple[str, int]]) -> str:
    """Weighted vote of the tokens of ``values``, all aligned to the heaviest; of equal ones, to the smallest text."""
    if not values:
        return ""
    order = sorted(values, key=lambda v: (-v[1], v[0]))
    backbone, total = split(order[0][0]), sum(w for _, w in order)
    slots: dict[int, dict[str, int]] = {}
    for value, weight in order[1:]:
        for slot, token in votes_against(backbone, split(value)):
            column = slots.setdefault(slot, {})
            column[token] = column.get(token, 0) + weight
    changes = {}
    for slot, column in slots.items():
        weight, token = max((w, t) for t, w in column.items())
        if weight > total - sum(column.values()):
            changes[slot] = token
    return rebuilt(backbone, changes)


def distance(value: str, other: str) -> float:
    """0 for equal token sequences, to 1 for ones without a common token."""
    if value == other:
        return 0.0
    a, b = split(value), split(other)
    begin, end = _middle(a, b)
    x, y = a[begin : len(a) - end], b[begin : len(b) - end]
    common = len(x) - _rows(x, y)[-1].bit_count() if x and y else 0
    return 1.0 - 2 * (begin + end + common) / (len(a) + len(b))


def weights(rows: list[dict]) -> list[int]:
    """Votes of whole values: see the module."""
    k = len(rows)
    beaten = [0] * k
    for c in ("chars", "seen", "trust"):
        order = sorted(r[c] for r in rows)
        for n, r in enumerate(rows):
            beaten[n] += k - bisect_right(order, r[c])
    return [WEIGHT // (1 + k * b) for b in beaten]


def _goes_on(end: str, rest: str) -> bool:
    """Whether ``rest``, behind ``end``, goes on with the text, and not with a site's name."""
    return bool(rest.strip().strip(" .…")) and not _SITE.match(rest) and not end.endswith((".", "!", "?", "。", "！", "？"))


def _cut_against(value: str, others: list[str]) -> bool:
    """Whether another value of the group goes on where this one stops."""
    end = value.rstrip()
    return any(len(o) > len(end) and o.startswith(end) and _goes_on(end, o[len(end) :]) for o in others)


_CHOSEN = "a long, b long, field string, value string, id long, best boolean"
_CHOSEN_NAMES = ["a", "b", "field", "value", "id", "best"]


_GIVEN = ("a", "b", "field", "value", "id", "seen", "trust", "most", "chars", "whole", "cut")


def _choose(rows: list[tuple], sentences: set[str]) -> tuple | None:
    """The survivor of one field of one group."""
    a, b, name = rows[0][:3]
    own = [dict(zip(_GIVEN[3:], r[3:], strict=True)) for r in rows if r[9] or r[10]]
    whole = [r for r in own if r["whole"]]
    if len(own) > 1 and name != "url" and name not in sentences:
        texts = [r["value"] for r in own]
        whole = [r for r in whole if not _cut_against(r["value"], texts)]
    if not whole:
        return None
    pick = whole[0]
    if len(whole) > 1:
        votes = weights(whole)
        agreed = consensus([(r["value"], w) for r, w in zip(whole, votes, strict=True)])
        pick = min(zip(whole, votes, strict=True), key=lambda x: (distance(x[0]["value"], agreed), -x[1], x[0]["id"]))[0]
    best = all(pick["chars"] >= r["chars"] and pick["seen"] >= r["seen"] and pick["trust"] >= r["most"] for r in whole)
    return a, b, name, pick["value"], pick["id"], best


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_CHOSEN_NAMES)


def _small_groups(sentences: set[str]):
    """Survivors of groups that arrive whole, sorted by group and field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(_GIVEN)
            at = _heads(batch)
            if held and _key(held[-1]) != _key(batch):
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(0, at[-1] if len(at) > 1 else batch.num_rows))
            if len(at) > 1:
                yield from work(pa.Table.from_batches(held))
                held = [batch.slice(at[-1])]
        if held:
            yield from work(pa.Table.from_batches(held))

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups: of those with one value no Python object is made."""
        (batch,) = table.combine_chunks().to_batches()
        heads = _heads(batch)
        sizes = np.diff(np.append(heads, batch.num_rows))
        one = batch.take(pa.array(heads[sizes == 1]))
        one = one.filter(one.column("whole"))
        if one.num_rows:
            yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("a", "b", "field", "value", "id")), pc.greater_equal(one.column("trust"), one.column("most"))], names=_CHOSEN_NAMES)
        many = np.repeat(sizes > 1, sizes)
        rows = list(zip(*(c.to_pylist() for c in batch.filter(pa.array(many)).columns), strict=True))
        out, at = [], 0
        for size in sizes[sizes > 1].tolist():
            if x := _choose(rows[at : at + size], sentences):
                out.append(x)
            at += size
        if out:
            yield _batch(out)

    return run


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    """Where groups begin in a batch."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for x in (batch.column("a"), batch.column("b"), batch.column("field").dictionary_encode().indices):
        x = x.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _key(batch: pa.RecordBatch) -> tuple:
    """Key of the first row; all rows of what is held have one key."""
    return tuple(batch.column(c)[0].as_py() for c in ("a", "b", "field"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its value up to the white space at the end."""
    for batch in batches:
        ends = pa.array([v.rstrip() for v in batch.column("value").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, ends], names=[*batch.schema.names, "end"])


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends that a value of their group goes on from; ends and values arrive sorted as texts.

    Texts that begin with an end follow it, so only the ends that begin the present text are held.
    """
    key, open_ = None, []
    for batch in batches:
        out = []
        for *own, text, full in zip(*(batch.column(c).to_pylist() for c in ("r", "a", "b", "field", "text", "full")), strict=True):
            if own != key:
                key, open_ = own, []
            while open_ and not text.startswith(open_[-1]):
                open_.pop()
            if full:
                found = [e for e in open_ if _goes_on(e, text[len(e) :])]
                out += [(*key[1:], e) for e in found]
                open_ = [e for e in open_ if e not in found] if found else open_
            elif not open_ or open_[-1] != text:
                open_.append(text)
        if out:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "field", "end"])


def _whole_of_group(values: DataFrame, large: DataFrame, sentences: set[str], parts: int) -> DataFrame:
    """Whole values of large groups without those that another value of the group continues.

    Texts are sorted by ranges. What an earlier range leaves open at the begin of a range are the ends that
    its first text begins with: one text per range, whose prefixes meet the ends in an equi-join.
    """
    on = ["a", "b", "field"]
    own = _meet(values.filter("whole or cut"), large.select(*on), on)
    own = cut_lineage(own.mapInArrow(_ends, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields) + ", end string"))
    labels = own.filter(~F.col("field").isin("url", *sentences))
    texts = labels.filter("whole").selectExpr(*on, "end as text", "false as full").unionAll(labels.selectExpr(*on, "value as text", "true as full"))
    order = [*on, "text", "full"]
    placed = cut_lineage(texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("r", F.shiftright(F.monotonically_increasing_id(), 33)))
    heads = placed.groupBy("r").agg(F.min(F.struct(*on, "text")).alias("h")).select("r", *(f"h.{c}" for c in on), F.col("h.text").alias("first"))
    begins = heads.select("r", *on, F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("first"), F.lit(1)))).alias("n"), "first")
    begins = begins.select("r", *on, F.expr("substring(first, 1, n)").alias("text"))
    open_ = _meet(placed.filter("not full").drop("r").distinct(), begins, [*on, "text"]).select("r", *order)
    ranges = placed.select("r", *order).unionByName(open_).repartition(parts, "r").sortWithinPartitions("r", *order)
    continued = ranges.mapInArrow(_continued, "a long, b long, field string, end string")
    return own.filter("whole").join(continued, [*on, "end"], "left_anti").drop("end")


def _weighted(whole: DataFrame) -> DataFrame:
    """Whole values of large groups with the votes that ``weights`` gives, and the maxima of their groups."""
    on = ["a", "b", "field"]
    top = whole.groupBy(*on).agg(F.max("chars").alias("mc"), F.max("seen").alias("ms"), F.max("most").alias("mt"), F.count("*").alias("k"))
    out = _meet(whole, top, on)
    for c in ("chars", "trust"):  # few lengths, and few weights in a registry
        above = Window.partitionBy(*on).orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, -1)
        ranks = whole.groupBy(*on, c).agg(F.count("*").alias("n")).withColumn(f"over_{c}", F.coalesce(F.sum("n").over(above), F.lit(0)))
        out = _meet(out, ranks.drop("n"), [*on, c])
    # times differ by value: rows are numbered by ranges, the first of equal ones says how many are later
    later = range_positions(whole.select(*on, "seen"), by=on, order=[F.desc("seen")]).groupBy(*on, "seen").agg((F.min("pos") - 1).alias("over_seen"))
    out = out.join(later, [*on, "seen"])
    return out.withColumn("weight", F.expr(f"{WEIGHT}L div (1 + k * (over_chars + over_seen + over_trust))")).drop("over_chars", "over_trust", "over_seen")


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``df`` through a function from the columns of a batch to rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in given:
            rows = list(run(*(c.to_pylist() for c in batch.columns)))
            kinds = kinds or [_KINDS[c.split()[1]] for c in schema.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.mapInArrow(batches, schema)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _votes(a: list, b: list, field: list, value: list, weight: list, backbone: list) -> Iterator[tuple]:
    for *own, v, w, heaviest in zip(a, b, field, value, weight, backbone, strict=True):
        if v != heaviest:
            for slot, token in votes_against(split(heaviest), split(v)):
                yield *own, slot, token, w


def _agreed(a: list, b: list, field: list, backbone: list, changes: list) -> Iterator[tuple]:
    for *own, heaviest, change in zip(a, b, field, backbone, changes, strict=True):
        yield *own, rebuilt(split(heaviest), {c["slot"]: c["token"] for c in change or ()})


def _with_distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the consensus, with the distance of ``value`` in its place."""
    for batch in batches:
        far = [distance(v, c) for v, c in zip(batch.column("value").to_pylist(), batch.column("agreed").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(far, pa.float64())], names=[*batch.schema.names[:-1], "far"])


def _large_groups(values: DataFrame, large: DataFrame, sentences: set[str], parts: int) -> DataFrame:
    """Survivors of groups with more distinct values than one task should hold."""
    on = ["a", "b", "field"]
    voted = cut_lineage(_weighted(cut_lineage(_whole_of_group(values, large, sentences, parts))))
    heads = voted.groupBy(*on).agg(F.min_by("value", F.struct(-F.col("weight"), "value")).alias("backbone"), F.sum("weight").alias("total"))
    heads = cut_lineage(heads)
    paired = _meet(voted.select(*on, "value", "weight"), heads.drop("total"), on)
    votes = _mapped(paired, _votes, "a long, b long, field string, slot long, token string, weight long")
    # all that one value of a slot and token adds is summed before it travels
    columns = votes.groupBy(*on, "slot", "token").agg(F.sum("weight").alias("weight")).groupBy(*on, "slot")
    columns = columns.agg(F.max(F.struct("weight", "token")).alias("top"), F.sum("weight").alias("others"))
    won = columns.join(heads.select(*on, "total"), on).filter(F.col("top.weight") > F.col("total") - F.col("others"))
    changes = won.groupBy(*on).agg(F.collect_list(F.struct("slot", F.col("top.token").alias("token"))).alias("changes"))
    agreed = _mapped(heads.drop("total").join(changes, on, "left"), _agreed, "a long, b long, field string, agreed string")
    near = _meet(voted.select(*on, "value", "id", "weight", "chars", "seen", "trust", "mc", "ms", "mt"), agreed, on)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in near.schema.fields[:-1]) + ", far double"
    best = (F.col("chars") >= F.col("mc")) & (F.col("seen") >= F.col("ms")) & (F.col("trust") >= F.col("mt"))
    near = near.mapInArrow(_with_distance, kinds).withColumn("best", best)
    picked = near.groupBy(*on).agg(F.min_by(F.struct("value", "id", "best"), F.struct("far", -F.col("weight"), "id")).alias("x"))
    return picked.select(*on, "x.value", "x.id", "x.best")


def _with_trust(df: DataFrame, registry: DataFrame) -> DataFrame:
    """With the largest registry weight among each row's engines; 0 where none is registered."""
    weight = registry.select(F.col("name").alias("_name"), "weight").filter("_name is not null and weight is not null").groupBy("_name").agg(F.max("weight").alias("_weight"))
    known = weight.limit(SMALL_REGISTRY + 1).collect()
    if len(known) <= SMALL_REGISTRY:
        pairs = F.map_from_arrays(F.array(*(F.lit(r._name) for r in known)).cast("array<string>"), F.array(*(F.lit(float(r._weight)) for r in known)).cast("array<double>"))
        top = F.array_max(F.transform("engines", lambda e: F.try_element_at(pairs, e)))
        return df.withColumn("trust", F.coalesce(top, F.lit(0.0)))
    names = df.select("id", F.explode("engines").alias("_name")).distinct()
    most = names.join(weight, "_name").groupBy("id").agg(F.max("_weight").alias("trust"))
    return df.join(most, "id", "left").fillna({"trust": 0.0})


def _grouped(df: DataFrame, registry: DataFrame, id_col: str, url_col: str, engines_col: str, seen_col: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with the two keys of their group, and ``a, b, first_id, n`` of the groups of two rows or more."""
    engines = F.coalesce(F.col(engines_col), F.array().cast("array<string>"))
    seen = F.coalesce(F.unix_micros(F.col(seen_col).cast("timestamp_ltz")), F.lit(-(1 << 62)))
    form = url_form(F.col(url_col))
    rows = (
        df.filter((F.col(url_col) != "") & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), form.alias("form"), F.col(url_col).alias("url"), engines.alias("engines"), seen.alias("seen"), *(F.col(f).alias(f"_{f}") for f in fields))
        .select(F.xxhash64("form").alias("a"), F.xxhash64(F.lit("tributary"), "form").alias("b"), "id", "url", "engines", "seen", *(f"_{f}" for f in fields))
    )
    groups = rows.groupBy("a", "b").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return _with_trust(rows, registry), groups


def _meet(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose other side is written, measured, and broadcast if it has at most ``SMALL_TABLE`` bytes."""
    other = cut_lineage(other)
    row = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in other.dtypes if kind == "string"), F.lit(64))
    size = other.agg(F.sum(row)).first()[0] or 0
    return df.join(F.broadcast(other) if size <= SMALL_TABLE else other, on, how)


def _stand_ins(values: DataFrame) -> DataFrame:
    """``field, value`` of the texts that stand on many pages and say nothing about most of them."""
    texts = values.filter("field <> 'url'").select("a", "b", "field", "value", "chars", F.xxhash64("value").alias("h"))
    common = texts.groupBy("field", "h").agg(F.count("*").alias("pages")).filter(F.col("pages") >= STAND_IN_PAGES)
    tagged = _meet(texts, common, ["field", "h"], "left")
    at = tagged.filter("pages is not null").select("a", "b", "field", "value")
    other = _meet(tagged.filter("pages is null"), at.select("a", "b", "field").distinct(), ["a", "b", "field"], "left_semi")
    other = other.groupBy("a", "b", "field").agg(F.max_by("value", F.struct("chars", "value")).alias("other"))
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(c), r"([\u3400-\u9fff])|[^\p{L}\p{N}]+", "$1 ")), " +"))
    x, y = words("value"), words("other")
    unlike = (2 * F.size(F.array_intersect(x, y)) < F.least(F.size(x), F.size(y))).cast("int")
    judged = at.join(other, ["a", "b", "field"]).groupBy("field", "value").agg(F.avg(unlike).alias("unlike"))
    return judged.filter("unlike > 0.5").select("field", "value", F.lit(True).alias("stand"))


def survivors(
    df: DataFrame,
    registry: DataFrame,
    *,
    id_col: str = "hit_id",
    url_col: str = "url",
    fields: tuple[str, ...] = ("title", "content"),
    engines_col: str = "engines",
    seen_col: str = "seen_at",
    block: int = BLOCK,
    with_url: bool = True,
) -> DataFrame:
    """``a, b, field, value, id, best`` of every field of every group of two rows or more.

    ``a, b`` name the group, ``id`` is the row of the chosen value, ``best`` says whether it has
    the most characters, was seen last and has the most trust of all whole values. Rows
    with a null or empty url or a null id form no group; null values are empty, a null time
    is the earliest. Ties go to the smallest id. Other columns are not read.
    """
    rows, groups = _grouped(df, registry, id_col, url_col, engines_col, seen_col, fields)
    return _survivors(df, rows, fields, block, with_url).join(groups.select("a", "b"), ["a", "b"])


def _survivors(df: DataFrame, rows: DataFrame, fields: tuple[str, ...], block: int, with_url: bool) -> DataFrame:
    """As ``survivors``, of groups of one row too."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = ", ".join([f"'{f}', `_{f}`" for f in fields] + ["'url', url"] * with_url)
    long = rows.selectExpr("a", "b", "id", "seen", "trust", f"stack({len(fields) + with_url}, {named}) as (field, value)").filter("value <> ''")
    # equal values of a group: the row seen last, of these the one with the most trust
    equal = long.groupBy("a", "b", "field", "value").agg(F.max(F.struct("seen", "trust", (-F.col("id")).alias("i"))).alias("top"), F.max("trust").alias("most"))
    equal = equal.selectExpr("a", "b", "field", "value", "-top.i as id", "top.seen as seen", "top.trust as trust", "most", "cast(char_length(value) as long) as chars")
    model = truncation.fit(df, fields=fields, source_col=None)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("field").to_pylist(), batch.column("value").to_pylist()
            keys = [(t, f, None) for t, f in zip(texts, names, strict=True)]
            some = list(dict.fromkeys(k for k in keys if k[1] != "url"))
            foreign = list(dict.fromkeys(k[0] for k in some if not k[0].isascii()))
            garbled = dict(zip(foreign, encodings.classify(foreign, model.garbled), strict=True))
            why, lacking = model.judge_known(some, truncation.facts_of(batch), garbled)
            cut = dict(zip(some, (bool(w) for w in why), strict=True))
            need = {some[i]: k for i, k in lacking.items()}
            bad = {k for k in some if (g := garbled.get(k[0])) and g[0]}
            stand = [k[1] != "url" and (k[0].strip().lower() in STAND_INS or not k[0].strip()) for k in keys]
            cuts = [cut.get(k, False) and not s for k, s in zip(keys, stand, strict=True)]
            whole = [not (c or s or k in bad) for k, c, s in zip(keys, cuts, stand, strict=True)]
            flagged = [c and k not in bad for k, c in zip(keys, cuts, strict=True)]
            needed = pa.array([need.get(k) for k in keys], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(whole), pa.array(flagged), needed], names=[*kept, "whole", "cut", "need"])

    kept = equal.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in equal.schema.fields) + ", whole boolean, cut boolean, need array<string>"
    values = cut_lineage(equal.mapInArrow(judge, kinds))
    if model.floor > 2:
        again = truncation.with_facts(values.filter("need is not null").select(*kept, "need"), model)
        values = values.filter("need is null").unionAll(cut_lineage(again.mapInArrow(judge, kinds)))
    values = _meet(values.drop("need"), _stand_ins(values), ["field", "value"], "left")
    known = F.col("stand").isNull()
    values = values.withColumns({"whole": F.col("whole") & known, "cut": F.col("cut") & known}).drop("stand")
    large = values.groupBy("a", "b", "field").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    some_large = bool(large.limit(1).count())
    small = values.join(large, ["a", "b", "field"], "left_anti") if some_large else values
    out = small.repartition(parts, "a", "b", "field").sortWithinPartitions("a", "b", "field").mapInArrow(_small_groups(model.sentences), _CHOSEN)
    return out.unionAll(_large_groups(values, large, model.sentences, parts).select("a", "b", "field", "value", "id", "best")) if some_large else out


def best_rows(df: DataFrame, registry: DataFrame, *, id_col: str = "hit_id", url_col: str = "url", title: str = "title", content: str = "content", engines_col: str = "engines", seen_col: str = "seen_at", block: int = BLOCK) -> DataFrame:
    """``first_id, title_id, content_id`` of the groups whose two survivors are best in everything."""
    rows, groups = _grouped(df, registry, id_col, url_col, engines_col, seen_col, (title, content))
    chosen = _survivors(df, rows, (title, content), block, False).filter("best")
    ids = [F.max(F.when(F.col("field") == f, F.col("id"))).alias(n) for f, n in ((title, "title_id"), (content, "content_id"))]
    both = chosen.groupBy("a", "b").agg(*ids).filter("title_id is not null and content_id is not null")
    return both.join(groups, ["a", "b"]).select("first_id", "title_id", "content_id")


def best_records(
    df: DataFrame, registry: DataFrame, *, id_col: str = "hit_id", url_col: str = "url", fields: tuple[str, ...] = ("title", "content"), engines_col: str = "engines", seen_col: str = "seen_at", block: int = BLOCK
) -> DataFrame:
    """One row per group: ``first_id, n, url, <fields>, engines``; a field without a whole value is null.

    ``engines`` is the union over the group, sorted; it has no more entries than there are
    engines.
    """
    rows, groups = _grouped(df, registry, id_col, url_col, engines_col, seen_col, fields)
    chosen = _survivors(df, rows, fields, block, True)
    flat = chosen.groupBy("a", "b").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("url", *fields)))
    union = rows.select("a", "b", F.explode_outer("engines").alias("e")).groupBy("a", "b").agg(F.array_sort(F.collect_set("e")).alias("engines"))
    out = groups.join(union, ["a", "b"]).join(flat, ["a", "b"], "left")
    return out.select("first_id", "n", "url", *fields, "engines")
