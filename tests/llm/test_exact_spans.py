import random

from tributary.llm import exact_spans


def brute_pairs(docs, k):
    grams = {i: {t[x : x + k] for x in range(len(t) - k + 1)} for i, t in docs.items() if t}
    return {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}


def brute_shared(docs, k):
    out = {}
    for i, t in docs.items():
        hit = set()
        for x in range(len(t or "") - k + 1):
            if any(t[x : x + k] in u for j, u in docs.items() if j != i and u):
                hit |= set(range(x, x + k))
        if hit:
            out[i] = len(hit)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé温") for _ in range(n))
    blocks = [word(rng.randint(8, 30)) for _ in range(6)] + ["ab" * 20, "a" * 40]
    docs = {}
    for i in range(40):
        docs[i] = "".join(rng.choice(blocks) if rng.random() < 0.4 else word(rng.randint(3, 20)) for _ in range(rng.randint(0, 5)))
    docs[50], docs[51], docs[52] = docs[3], docs[3], docs[4]
    return docs


def test_against_brute_force(spark, monkeypatch):
    for seed, hot, listed in ((1, 50_000, 9), (2, 3, 10_000), (3, 3, 0), (4, 50_000, 0)):
        monkeypatch.setattr(exact_spans, "LISTED", listed)
        docs = corpus(seed)
        rows = [(i, t, "x") for i, t in docs.items()] + [(3, docs[3], "again"), (60, None, "x"), (61, "", "x")]
        df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
        got = [tuple(r) for r in exact_spans.shared_pairs(df, span=12, minimiser=4, hot=hot).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute_pairs(docs, 12)
        first = {}
        for i, t in sorted(docs.items()):
            first.setdefault(t, i)
        classes = {r.doc_id: (r.class_id, r.n) for r in exact_spans.members(df, span=12).collect()}
        assert classes == {i: (first[t], sum(u == t for u in docs.values())) for i, t in docs.items() if len(t) >= 12}
        pairs = {tuple(r) for r in exact_spans.class_pairs(df, span=12, minimiser=4, hot=hot).collect()}
        assert pairs == {p for p in brute_pairs(docs, 12) if all(first[docs[i]] == i for i in p)}
        share = {r.doc_id: r.shared_chars for r in exact_spans.shared_share(df, span=12, minimiser=4, hot=hot).collect()}
        assert share == brute_shared(docs, 12)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(exact_spans, "_PIECE", 50)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    core = word(60)
    docs = [(1, word(300) + core + word(50), 0, 0), (2, word(77) + core[:40] + word(200), 0, 0), (3, word(400), 0, 0)]
    pieces = [(i, at, ord(t[at - 1]) if at else exact_spans._START, t[at : at + 61]) for i, t, *_ in docs for at in range(0, len(t) - 11, 50)]
    rolling = exact_spans._Rolling(exact_spans._MULTIPLIERS[0])
    import numpy as np

    _, ids, starts, before, parts = exact_spans._superkmers(pieces, 12, 5, rolling)
    both = tuple(map(exact_spans._Rolling, exact_spans._MULTIPLIERS))
    d, s, c, part, inner, one, two = exact_spans._windows(np.array(ids), np.array(starts), np.array(before), parts, 12, both)
    texts = {i: t for i, t, *_ in docs}
    assert sorted(zip(d.tolist(), s.tolist(), strict=True)) == sorted((i, x) for i, t in texts.items() for x in range(len(t) - 11))
    hit = exact_spans._beginnings(one, d, c)
    a, b = 300, 77
    while texts[1][a - 1] == texts[2][b - 1]:
        a, b = a - 1, b - 1
    assert {(int(d[h]), int(s[h])) for h in hit} == {(1, a), (2, b)}
    assert {parts[part[h]][inner[h] : inner[h] + 12] for h in hit} == {texts[1][a : a + 12]}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_spans.shared_pairs(df).count() == 0
    assert exact_spans.shared_share(df).count() == 0
