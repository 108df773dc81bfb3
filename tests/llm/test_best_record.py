import datetime as dt
import functools
import os
import random

import pytest

from tributary.llm import best_record as br

NOUNS = ["garden", "lantern", "kettle", "harbor", "turbine", "marble", "granary", "pendulum"]
SCHEMA = "hit_id long, url string, title string, content string, engines array<string>, seen_at timestamp, id string, a long"
T0 = dt.datetime(2025, 1, 1)
REGISTRY = [("A", 1.5), ("B", 1.0), ("C", 0.5)]


def test_consensus_of_tokens():
    values = [("the old kettle repairs a garden", 1.0), ("the old kettle repairs garden", 0.8), ("the cold kettle repairs a garden", 0.5)]
    assert br.consensus(values) == "the old kettle repairs a garden"
    assert br.consensus([("x y z", 5.0), ("x", 1.0), ("x", 1.0)]) == "x y z"
    assert br.consensus([("a b d", 1.0), ("a b c d", 1.1), ("a c d", 1.0)]) == "a b c d"
    assert br.consensus([("温暖的陶罐", 1.0), ("温暖的陶罐", 1.0), ("温暖陶罐", 1.5)]) == "温暖的陶罐"
    assert br.consensus([]) == ""


def test_votes_of_one_value_give_it_back():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.choice("uvwx ") for _ in range(rng.randint(0, 9))] for _ in range(2))
        votes = br.votes_against(a, b)
        assert len(dict(votes)) == len(votes)
        assert br.rebuilt(a, dict(votes)) == "".join(b)
        best = 0
        for mask in range(1 << len(a)):  # the longest common subsequence, by trying all
            rest = iter(b)
            some = [t for i, t in enumerate(a) if mask >> i & 1]
            if len(some) > best and all(t in rest for t in some):
                best = len(some)
        assert len(br._matches(a, b)) == best
        if a or b:
            x, y = "-".join(a), "-".join(b)
            own = (br.split(x), br.split(y))
            assert br.distance(x, y) == pytest.approx(0.0 if x == y else 1 - 2 * len(br._matches(*own)) / (len(own[0]) + len(own[1])))


def test_a_value_that_nothing_beats_outvotes_all():
    rows = [{"chars": 9, "seen": 9, "trust": 9.0}] + [{"chars": i, "seen": 8 - i, "trust": 1.0} for i in range(8)]
    w = br.weights(rows)
    assert w[0] > sum(w[1:])


def rows(seed, pages=150):
    rng = random.Random(seed)
    out, n = [], 0
    for p in range(pages):
        base = f"Item {p} of the {rng.choice(NOUNS)} {rng.choice(NOUNS)}"
        body = f"The {rng.choice(NOUNS)} of page number {p} shields the {rng.choice(NOUNS)} and the {rng.choice(NOUNS)}."
        for _ in range(rng.randint(1, 6)):
            n += 1
            title = rng.choice([base, f"Guide {p % 7}: {base.lower()}", "Untitled", "", None])
            content = rng.choice([body, body, body + f" It has the {rng.choice(NOUNS)}.", body[: len(body) // 2], "", "n/a", None])
            engines = rng.choice([["A"], ["B", "C"], ["C", "C"], [], None, ["unknown"]])
            url = rng.choice(["https://h.example/p{}", "HTTP://H.example/p{}/", "//h.example/p{}#"]).format(p)
            out.append((n, url, title, content, engines, T0 + dt.timedelta(hours=rng.randint(0, 40)), "x", 5))
    return [*out, (9001, "", "a", "b.", ["A"], T0, "x", 5), (9002, None, "a", "b.", ["A"], T0, "x", 5)]


def brute(data):
    weight = dict(REGISTRY)
    groups = {}
    for r in data:
        if r[1]:
            groups.setdefault(r[1].lower().split("/p")[-1].strip("/#"), []).append(r)
    found = set()
    for g in groups.values():
        if len(g) < 2:
            continue
        ids = []
        for k in (2, 3):
            whole = [r for r in g if r[k] and r[k] not in ("Untitled", "n/a") and (k == 2 or r[k].endswith("."))]
            full = [(len(r[k]), r[5], max((weight.get(e, 0.0) for e in r[4] or []), default=0.0), r[0]) for r in whole]
            best = [f for f in full if all(f[i] >= o[i] for o in full for i in range(3))]
            ids.append(min((f[3] for f in best), default=None))
        if None not in ids:
            found.add((min(r[0] for r in g), *ids))
    return found


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([*REGISTRY, ("A", 1.5)], "name string, weight double")


@pytest.mark.parametrize("block", [256, 2])
def test_against_brute_force(spark, registry, block):
    data = rows(7)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = [tuple(r) for r in br.best_rows(df, registry, block=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(data)


def test_records(spark, registry):
    data = [
        (1, "http://h.example/x", "Old kettle", "The kettle is old.", ["B"], T0, "x", 5),
        (2, "https://h.example/X/", "Old kettle repair", "", ["A", "B"], T0 + dt.timedelta(1), "x", 5),
        (3, "h.example/x", None, None, None, None, "x", 5),
        (4, "h.example/lonely", "t", "c.", ["A"], T0, "x", 5),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    (r,) = br.best_records(df, registry).collect()
    assert (r.first_id, r.n, r.title, r.content, r.engines) == (1, 3, "Old kettle repair", "The kettle is old.", ["A", "B"])
    assert br.best_records(df.limit(0), registry).count() == 0
    assert br.best_rows(df.limit(0), registry).count() == 0


def nested(pages=40):
    """Titles that begin other titles; the shortest is often seen last or has the most trust."""
    rng = random.Random(11)
    out = []
    for p in range(pages):
        words = f"Item {p} of the {rng.choice(NOUNS)} and the {rng.choice(NOUNS)} beside a {rng.choice(NOUNS)}".split()
        titles = [" ".join(words[:n]) for n in (4, 7, len(words))] + [" ".join(words) + " - Annex", "Other " + " ".join(words[2:]), " ".join(words[:4]) + " \u3000"]
        for title in rng.sample(titles, rng.randint(3, 6)):
            body = f"The {rng.choice(NOUNS)} shields item {p}."
            out.append((len(out) + 1, f"h.example/n{p}", title, body, [rng.choice("ABC")], T0 + dt.timedelta(hours=rng.randint(0, 3)), "x", 5))
    return out


def test_titles_cut_at_words_do_not_depend_on_group_size(spark, registry, monkeypatch):
    df = spark.createDataFrame(nested(), SCHEMA).repartition(3)
    small, large = ({tuple(r) for r in br.best_rows(df, registry, block=b).collect()} for b in (256, 2))
    assert large == small
    with monkeypatch.context() as m:  # nothing is small enough to be broadcast, or looked up in a literal map
        m.setattr(br, "SMALL_TABLE", 0)
        m.setattr(br, "SMALL_REGISTRY", 0)
        assert {tuple(r) for r in br.best_rows(df, registry, block=2).collect()} == small
    # the cut title was seen last and has more trust: the whole one is best all the same
    rows = [
        (1, "h.example/k", "The old kettle beside", "The kettle is old.", ["A"], T0 + dt.timedelta(2), "x", 5),
        (2, "h.example/k", "The old kettle beside the harbor", "The kettle is old.", ["B"], T0 + dt.timedelta(1), "x", 5),
        (3, "h.example/k", "A kettle", "The kettle is old.", ["C"], T0, "x", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [[tuple(r) for r in br.best_rows(df, registry, block=b).collect()] for b in (256, 2)] == [[(1, 2, 1)]] * 2


def test_ends_left_open_by_earlier_ranges(spark):
    """Sorted texts in many ranges: each end is found whatever range its continuation falls into."""
    rng = random.Random(17)
    texts = set()
    for _ in range(60):
        words = [rng.choice(NOUNS) for _ in range(6)]
        texts |= {" ".join(words[:n]) for n in rng.sample(range(1, 7), 3)}
    texts = sorted(texts)
    rows = [(1, 2, "title", t, i, 0, 1.0, 1.0, len(t), True, False) for i, t in enumerate(texts)] + [(3, 4, "title", texts[0], 999, 0, 1.0, 1.0, 5, True, False)]
    values = spark.createDataFrame(rows, "a long, b long, field string, value string, id long, seen long, trust double, most double, chars long, whole boolean, cut boolean")
    large = spark.createDataFrame([(1, 2, "title"), (3, 4, "title")], "a long, b long, field string")
    want = {t for t in texts if not br._cut_against(t, texts)}
    for parts in (1, 2, 9, 40):
        got = [(r.a, r.value) for r in br._whole_of_group(values.repartition(3), large, set(), parts).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(1, t) for t in want} | {(3, texts[0])}


def test_all_survivors_are_alike_for_every_block(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    df, registry = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("cached_hits", "engines"))
    some = [sorted(map(tuple, br.survivors(df, registry, block=b).collect())) for b in (256, 2)]
    assert len(some[0]) == 1514 and some[0] == some[1]
    assert sum(not r[5] for r in some[0]) > 50  # the vote decided these


def brute_record(rows, field):
    """Survivor of whole values by the definition: votes counted column by column on fractions."""
    k = len(rows)
    beaten = lambda r: sum((o[1] > r[1]) + (o[2] > r[2]) + (o[3] > r[3]) for o in rows)
    votes = sorted(((br.WEIGHT // (1 + k * beaten(r)), r[0]) for r in rows), key=lambda v: (-v[0], v[1]))
    base = br.split(votes[0][1])
    total = sum(w for w, _ in votes)
    slots = {}
    for w, text in votes:
        for slot, token in br.votes_against(base, br.split(text)):
            slots.setdefault(slot, []).append((token, w))
    changes = {}
    for slot, cast in slots.items():
        sums = {t: sum(w for u, w in cast if u == t) for t, _ in cast}
        top = max(sums, key=lambda t: (sums[t], t))
        if sums[top] > total - sum(sums.values()):
            changes[slot] = top
    agreed = br.rebuilt(base, changes)
    weight = {t: w for w, t in votes}
    return min(rows, key=lambda r: (br.distance(r[0], agreed), -weight[r[0]], r[4]))[0]


@pytest.mark.parametrize("block", [256, 2])
def test_records_by_vote(spark, registry, block):
    """No value is best in everything, so the vote decides."""
    rng = random.Random(13)
    data, want = [], {}
    trust = {"A": 1.5, "B": 1.0, "C": 0.5}
    for p in range(30):
        base = f"The {rng.choice(NOUNS)} of page {p} shields the {rng.choice(NOUNS)} and a {rng.choice(NOUNS)} near it".split()
        group = []
        for n in range(rng.randint(3, 7)):
            own = [w for w in base if rng.random() > 0.15] or base
            own.insert(rng.randint(0, len(own)), rng.choice(NOUNS))
            text, engine, hours = " ".join(own) + f" {n}.", rng.choice("ABC"), rng.randint(0, 50)
            data.append((len(data) + 1, f"h.example/v{p}", f"Item {p}", text, [engine], T0 + dt.timedelta(hours=hours), "x", 5))
            group.append((text, len(text), hours, trust[engine], len(data)))
        want[p] = brute_record(group, "content")
    got = {int(r.url.rsplit("v", 1)[1]): r.content for r in br.best_records(spark.createDataFrame(data, SCHEMA), registry, block=block).collect()}
    assert got == want


def test_weights_of_large_groups(spark):
    rng = random.Random(3)
    data = [(g, 0, "title", f"{g} {i}", i, rng.randint(0, 9), float(rng.randint(0, 3)), 3.0, rng.randint(1, 9)) for g in range(3) for i in range(60)]
    whole = spark.createDataFrame(data, "a long, b long, field string, value string, id long, seen long, trust double, most double, chars long")
    got = {r.value: r.weight for r in br._weighted(whole.repartition(3)).collect()}
    for g in range(3):
        own = [r for r in data if r[0] == g]
        votes = br.weights([{"chars": r[8], "seen": r[5], "trust": r[6]} for r in own])
        assert [got[r[3]] for r in own] == votes


def test_rare_words_cut_titles(spark, registry, monkeypatch):
    data = rows(5, pages=60)
    data += [(5000 + i, f"h.example/r{i}", f"Old {NOUNS[i]} zymoscope", "The kettle is old.", ["A"], T0, "x", 5) for i in range(5)]
    data += [(6000 + i, f"h.example/r{i}", "A much older and longer zymosc", "The kettle is old.", ["A"], T0, "x", 5) for i in range(2)]
    df = spark.createDataFrame(data, SCHEMA)
    fit, got = br.truncation.fit, []
    for share in (0, 0.005):
        monkeypatch.setattr(br.truncation, "fit", functools.partial(fit, least_share=share))
        got.append({tuple(r) for r in br.best_rows(df, registry).collect()})
    assert got[0] == got[1]
    assert {(5000, 5000, 5000), (5001, 5001, 5001)} <= got[1]
