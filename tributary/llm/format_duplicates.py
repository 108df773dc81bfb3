"""Duplicates hidden by formatting: progressive partition refinement over urls.

Two urls are copies if nothing differs but scheme, white space (also percent-encoded),
letter case, punctuation and the order of parameters. What is left of a url is

* the sequence of runs of letters and digits of host and path, and
* its parameters, each with the runs of its name and of its value, in any order.

Refinement, each step only inside the classes with several members that the step before has left:

1. *stripped length*, invariant under every allowed difference;
2. *letter histogram*, as one 64-bit value;
3. *the exact form* (ordered runs, sorted parameters), as two independent 64-bit values.

A step is a grouped count, combined on the map side, whose classes of several meet the rows in a
semi-join on the same plain columns, so counts are not shuffled again; the next step has other
columns, so that adaptive execution may split the rows of a hot class. No step holds a
group in one task: classes and groups are aggregates with partial aggregation, and rows meet
them in joins whose hot keys adaptive execution splits. The first two joins carry urls; what
is left after the third step is numbers, written once and read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.plans.storage import cut_lineage

_NOT_RUN = r"[^\p{L}\p{M}\p{N}]+"
#: Percent-encoded white space: tab to carriage return, space, no-break space.
_CODED_SPACE = r"%(?:20|0[9a-d]|c2%a0)"


def _bare(url: Column) -> Column:
    """Lower case, white space decoded, wrapping punctuation and scheme removed."""
    u = F.regexp_replace(F.lower(url), _CODED_SPACE, " ")
    u = F.replace(u, F.lit("&amp;"), F.lit("&"))
    u = F.regexp_replace(u, r"^[^\p{L}\p{N}/]+", "")
    return F.regexp_replace(u, r"^(?:[a-z][a-z0-9+.-]*:(?=//))?/+", "")


def _runs(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, _NOT_RUN, " "))


def stripped(url: Column) -> Column:
    """The letters and digits of a url."""
    return F.regexp_replace(_bare(url), _NOT_RUN, "")


def letter_histogram(letters: Column) -> Column:
    """How often each letter stands in a text, hashed to 64 bits with its length."""
    return F.xxhash64(F.length(letters), F.array_join(F.array_sort(F.split(letters, "")), ""))


def url_form(url: Column) -> Column:
    """The exact form of a url as one string; equal for copies and only for them."""
    b = _bare(url)
    path = _runs(F.substring_index(b, "?", 1))
    query = F.regexp_replace(b, r"^[^?]*\??", "")
    params = F.transform(
        F.split(query, "[&;]"),
        lambda p: F.concat(_runs(F.substring_index(p, "=", 1)), F.lit("="), _runs(F.regexp_replace(p, "^[^=]*=?", ""))),
    )
    params = F.array_sort(F.filter(params, lambda p: p != "="))
    return F.concat(path, F.lit("?"), F.array_join(params, "&"))


_GROUP = ("_g", "_null")


def _several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys other rows have too."""
    # the id is counted too, so that both sides of the join need the same columns and share what was shuffled
    classes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_id").alias("_any")).filter("_n > 1 and _any is not null").select(*keys)
    return rows.join(classes, keys, "left_semi")


def _grouped(df: DataFrame, group_col: str | None, id_col: str, url_col: str) -> tuple[DataFrame, DataFrame]:
    """Members of classes with several rows (``_g, _null, _id, _a, _b``), and their groups."""
    g = F.lit(0).cast("long") if group_col is None else F.col(group_col)
    kind = df.select(g.alias("_g")).schema["_g"].dataType
    # a null is a group of its own: as two plain columns, it needs no null-safe join
    rows = df.select(F.coalesce(g, F.lit("0").cast(kind)).alias("_g"), g.isNull().alias("_null"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).filter((F.col("_url") != "") & F.col("_id").isNotNull())
    rows = _several(rows.withColumn("_length", F.length(stripped(F.col("_url")))), [*_GROUP, "_length"])
    # without the length as a column, so that rows of one length, however many, are counted where they lie
    rows = _several(rows.withColumn("_letters", letter_histogram(stripped(F.col("_url")))).drop("_length"), [*_GROUP, "_letters"])
    form = rows.select(*_GROUP, "_id", url_form(F.col("_url")).alias("_form"))
    members = cut_lineage(form.select(*_GROUP, "_id", F.xxhash64("_form").alias("_a"), F.xxhash64(F.lit("tributary"), "_form").alias("_b")))
    groups = members.groupBy(*_GROUP, "_a", "_b").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    return members, groups


def find_copies(df: DataFrame, *, group_col: str | None = "query_id", id_col: str = "result_id", url_col: str = "url") -> DataFrame:
    """One row ``first_id, <id_col>`` for every row that is not the first of its group.

    Null and empty urls and null ids belong to no group; a null in ``group_col`` is a group of its
    own; an id names one row. An empty table gives no rows. Only the named columns are
    read, so other columns may have any name. The first row is the one with the smallest id.
    """
    members, groups = _grouped(df, group_col, id_col, url_col)
    out = members.join(groups, [*_GROUP, "_a", "_b"]).filter(F.col("_id") != F.col("_first"))
    return out.select(F.col("_first").alias("first_id"), F.col("_id").alias(id_col))


def collapse(df: DataFrame, *, group_col: str | None = "query_id", id_col: str = "result_id", url_col: str = "url") -> DataFrame:
    """One row per page that has copies: ``<group_col>, first_id, n_copies``.

    Pages that stand once are left out, as are null and empty urls; ``unique_rows`` has them all.
    """
    _, groups = _grouped(df, group_col, id_col, url_col)
    keys = [] if group_col is None else [F.when(~F.col("_null"), F.col("_g")).alias(group_col)]
    return groups.select(*keys, F.col("_first").alias("first_id"), F.col("_n").alias("n_copies"))


def unique_rows(df: DataFrame, *, group_col: str | None = "query_id", id_col: str = "result_id", url_col: str = "url") -> DataFrame:
    """The collapsed table: the first row of every page, whole, with ``n_copies`` (1 for a page that stands once).

    A row with a null or empty url names no page and stays as it is, so the numbers of copies
    add up to the rows of ``df``. ``n_copies`` replaces a column of that name.
    """
    members, groups = _grouped(df, group_col, id_col, url_col)
    held = members.join(groups, [*_GROUP, "_a", "_b"]).select(F.col("_id").alias("_member"), "_first", "_n")
    out = df.join(held, F.col(id_col) == F.col("_member"), "left").filter("_member is null or _member = _first")
    return out.select(*(F.col(c) for c in df.columns if c != "n_copies"), F.coalesce("_n", F.lit(1).cast("long")).alias("n_copies"))
