import random

import pytest

from tributary.operators import fuse as fusion
from tributary.operators import rank

SCHEMA = "query_id long, engine_ord int, engine string, pos int, url string, title string, content string, result_type string, thumbnail string, published_date string"


def lists(spark, *rows):
    full = [(1, *r, *([None] * (9 - len(r)))) for r in rows]
    return spark.createDataFrame([tuple(x if i != 7 else (x or "web") for i, x in enumerate(r)) for r in full], SCHEMA)


def weights(spark, **w):
    return spark.createDataFrame(list(w.items()), "engine string, weight double")


def by_key(df):
    return {r.key: r for r in df.collect()}


def test_empty(spark):
    assert fusion.fuse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_and_longest(spark):
    df = lists(
        spark,
        (0, "e1", 1, "https://example.com/page", "Title 1", "c"),
        (0, "e1", 2, "https://other.com", "Other", ""),
        (1, "e2", 1, "http://example.com/page/", "Title 2 Longer", "longer"),
    )
    got = by_key(fusion.fuse(df))
    assert set(got) == {"example.com/page", "other.com"}
    r = got["example.com/page"]
    assert (r.url, r.title, r.content, r.engines, r.positions) == ("https://example.com/page", "Title 2 Longer", "longer", ["e1", "e2"], [1, 1])


def test_bytes_decide_and_the_first_wins_ties(spark):
    df = lists(spark, (0, "a", 1, "u", "ee", "x1"), (1, "b", 1, "u", "éé", "x2"))
    r = fusion.fuse(df).first()
    assert (r.title, r.content) == ("éé", "x1")


def test_rows_at_one_place(spark):
    rows = [(0, "a", 1, "https://u", "tb", "c"), (0, "a", 1, "http://u", "ta", "c")]
    for order in (rows, rows[::-1]):
        r = fusion.fuse(lists(spark, *order).repartition(2)).first()
        assert (r.url, r.title, r.positions) == ("http://u", "ta", [1, 1])


def test_first_that_is_not_null(spark):
    df = lists(spark, (0, "a", 1, "u", "t", "c", "web", None, None), (1, "b", 1, "u", "t", "c", "news", "thumb", "2024-01-15"), (2, "c", 1, "u", "t", "c", "web", "other", "2025"))
    r = fusion.fuse(df).first()
    assert (r.result_type, r.thumbnail, r.published_date) == ("web", "thumb", "2024-01-15")


@pytest.mark.parametrize(
    ("rows", "w", "priority", "score"),
    [
        ([(0, "e1", 1), (1, "e2", 1)], {"e1": 2.0, "e2": 1.0}, "normal", 8.0),
        ([(0, "g", 1), (1, "w", 2)], {"g": 1.5, "w": 1.2}, "normal", 5.4),
        ([(0, "a", 1), (0, "a", 3)], {}, "normal", 4 / 3),
        ([(0, "x", 1)], {}, "normal", 1.0),
        ([(0, "a", 5)], {"a": 2.0}, "high", 2.0),
        ([(0, "a", 1), (0, "a", 2)], {"a": 2.0}, "high", 4.0),
        ([(0, "a", 1)], {"a": 2.0}, "low", 0.0),
        ([(0, "a", 1), (1, "b", 2)], {"a": 0.0, "b": 3.0}, "normal", 0.0),
        ([(0, "a", 1), (1, "b", 2)], {"a": -2.0, "b": 3.0}, "normal", -18.0),
        ([(0, "a", 1), (1, "b", 1)], {"a": 2.0, "b": 2.0}, "normal", 16.0),
    ],
)
def test_scores(spark, rows, w, priority, score):
    df = lists(spark, *((o, e, p, "https://x", "t", "c") for o, e, p in rows))
    table = weights(spark, **w) if w else None
    assert fusion.fuse(df, table, priority=priority).first().score == pytest.approx(score)
    assert fusion.fused_scores(df, table, priority=priority).first().score == pytest.approx(score)


def test_consensus_comes_first(spark):
    df = lists(spark, (0, "e1", 1, "single", "s", ""), (0, "e1", 2, "both", "b", ""), (1, "e2", 1, "both", "b", ""))
    got = rank.top_results(fusion.fuse(df), 10).collect()
    assert [(r.key, r.score) for r in got] == [("both", 3.0), ("single", 1.0)]


def test_ties_are_ordered(spark):
    df = lists(spark, (1, "b", 1, "z", "", ""), (0, "a", 1, "y", "", ""), (1, "b", 2, "q", "", ""))
    assert [r.key for r in rank.top_k(fusion.fuse(df), None).orderBy("rank").collect()] == ["y", "z", "q"]
    assert rank.limit_counts(fusion.fuse(df), 2).first().asDict() == {"query_id": 1, "count_before": 3, "count_after": 2}


@pytest.mark.parametrize("long_list", [1_000_000, 5])
def test_positions_of_long_lists(spark, long_list):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i // 300, rng.randint(0, 9), i) for i in range(900)] + [("z", 9, 1, 901)]
    df = spark.createDataFrame(rows, "e string, q int, s int, i int").repartition(7)
    got = rank.enumerate_positions(df, by=["e", "q"], order=[F.desc("s"), F.asc("i")], long_list=long_list)
    assert dict(got.dtypes)["pos"] == "int"
    want = {}
    for e, q, s, i in sorted(rows, key=lambda r: (-r[2], r[3])):
        want.setdefault((e, q), []).append(i)
    assert sorted((r.i, r.pos) for r in got.collect()) == sorted((i, p) for own in want.values() for p, i in enumerate(own, 1))


def test_small_scores_keep_their_order(spark):
    df = lists(spark, (0, "a", 2, "low", "", ""), (1, "a", 1, "high", "", ""))
    assert [r.key for r in rank.top_results(fusion.fuse(df, weights(spark, a=1e-12)), 2).collect()] == ["high", "low"]


def test_what_rows_already_carry(spark):
    rows = [(1, 0, "a", 2, "u", "t", "c", ["x", "b"], [7]), (1, 1, "b", 1, "u", "t", "c", ["z"], [9]), (1, 1, "b", 3, "v", "t", "c", None, None)]
    df = spark.createDataFrame(rows, "query_id long, engine_ord int, engine string, pos int, url string, title string, content string, seed_engines array<string>, seed_positions array<int>")
    got = by_key(fusion.fuse(df, weights(spark, a=2.0, b=3.0, x=0.5)))
    assert (got["u"].engines, got["u"].positions) == (["a", "b", "x"], [7, 2, 1])
    assert got["u"].score == pytest.approx(2 * 3 * 0.5 * 3 * (1 / 7 + 1 / 2 + 1))
    assert (got["v"].engines, got["v"].positions) == (["b"], [3])


def test_last_registration_counts(spark):
    reg = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "engine_ord int, name string, weight double")
    assert {r.engine: r.weight for r in fusion.weight_table(reg).collect()} == {"a": 3.0, "b": 2.0}


def model(rows, w):
    """A sequential merge in plain Python."""
    out = {}
    for q, o, e, p, url, title, content in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        key = url.removeprefix("https://").rstrip("/").lower()
        r = out.setdefault((q, key), {"url": url, "title": title, "content": content, "engines": set(), "positions": []})
        for f, v in (("title", title), ("content", content)):
            if len(v.encode()) > len(r[f].encode()):
                r[f] = v
        r["engines"].add(e)
        r["positions"].append(p)
    for r in out.values():
        product = 1.0
        for e in sorted(r["engines"]):
            product *= w.get(e, 1.0)
        r["score"] = sum(product * len(r["engines"]) / p for p in r["positions"])
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_against_a_sequential_merge(spark, parts):
    rng = random.Random(11)
    rows = []
    for q in range(20):
        for o, e in enumerate("abcd"):
            for p in range(1, rng.randint(1, 8)):
                k = rng.randint(0, 9)
                rows.append((q, o, e, p, f"https://Host/{k}" + "/" * rng.randint(0, 2), "té"[: rng.randint(0, 2)] * rng.randint(0, 4), "x" * rng.randint(0, 3)))
    w = {"a": 1.5, "b": 0.5, "c": 2.0}
    names = "query_id long, engine_ord int, engine string, pos int, url string, title string, content string"
    rng.shuffle(rows)
    got = fusion.fuse(spark.createDataFrame(rows, names).repartition(parts), weights(spark, **w)).collect()
    want = model(rows, w)
    assert {(r.query_id, r.key) for r in got} == set(want)
    for r in got:
        m = want[r.query_id, r.key]
        assert (r.url, r.title, r.content, r.engines, r.positions) == (m["url"], m["title"], m["content"], sorted(m["engines"]), m["positions"])
        assert r.score == pytest.approx(m["score"])
