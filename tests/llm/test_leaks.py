import random

import pytest

from tributary.llm import leaks

PASSAGE = "Seit 1997 gilt Gruska als Ort ohne Dose; zuerst zerbrach übliche Kiste, 26 Zeugen sahen warme Ecke am Fluss."


def find(text, edits=2, items=((1, PASSAGE, "wo liegt Gruska"),)):
    return leaks.Matcher(list(items), edits).find(text)


@pytest.mark.parametrize(
    ("text", "case"),
    [
        ("vorher " + PASSAGE + " nachher", True),
        ("x GILT  GRUSKA als\nort ohne dose: zuerst zerbrach ubliche kiste 26 y", True),
        ("x gilt Gruska als neuer Ort ohne Dose; zuerst zerbrach übliche Truhe, 26 Zeugen y", True),
        ("x gilt Gruska als Ort ohne Dose; zuerst y", False),
        ("wo liegt Gruska", False),
        ("gilt als Gruska Ort Dose ohne zerbrach zuerst Kiste übliche Zeugen 26 sahen", False),
        ("", False),
    ],
)
def test_cases(text, case):
    assert bool(find(text)) is case


def test_offsets_and_query():
    text = "… Q: Wo liegt  Gruska? A: " + PASSAGE
    ((item, begin, end, share, asked),) = find(text)
    assert (item, share, asked) == (1, 1.0, True)
    assert text[begin:end] == PASSAGE[:-1]


def brute(passage, text, edits):
    """Longest stretch of the passage, by edit distance between all substrings that begin and end alike."""
    a, b = leaks.words(passage)[0], leaks.words(text)[0]
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j]:
                continue
            row = {(0, 0): 0}
            for x in range(len(a) - i + 1):
                for y in range(len(b) - j + 1):
                    if (x, y) == (0, 0):
                        continue
                    d = min(row.get((x - 1, y), 99) + 1, row.get((x, y - 1), 99) + 1)
                    if x and y:
                        d = min(d, row.get((x - 1, y - 1), 99) + (a[i + x - 1] != b[j + y - 1]))
                    row[x, y] = d
                    if d <= edits and x and y and a[i + x - 1] == b[j + y - 1]:
                        best = max(best, x)
    return best


def test_seeds_cover_every_stretch():
    rng = random.Random(4)
    for _ in range(300):
        item = leaks.Item(1, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 40))), None)
        edits = rng.randint(0, 3)
        size, places = item.seeds(edits, leaks.Counter(item.words))
        for begin in range(len(item.words) - item.half + 1):
            own = [p for p in places if begin <= p and p + size <= begin + item.half]
            assert len(own) >= min(edits + 1, item.half)
            assert all(b - a >= size for a, b in zip(own, own[1:], strict=False))


def test_words_with_and_without_places():
    for text in ("A b-C 1x", "Größe 温暖ab ½ x²", "e\u0301te\u0301 \u200bzero\u200b ﬁx", "ÅNGSTRÖM İ", ""):
        assert leaks.plain_words(text) == leaks.words(text)[0]


def test_random_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        passage = [rng.choice("abcdefgh") for _ in range(rng.randint(4, 22))]
        text = list(passage[rng.randint(0, 3) : rng.randint(5, 14)])
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at : at + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
        text = [rng.choice("axyz")] * 2 + text + [rng.choice("bxyz")] * 2
        p, t = " ".join(passage), " ".join(text)
        got = find(t, 1, ((1, p, None),))
        want = brute(p, t, 1)
        assert bool(got) == (want >= (len(passage) + 1) // 2), (p, t, want)


def test_chinese():
    passage = "昔日匠人只信大型的水池，若无桥梁便用绳索代替。"
    assert find("前文昔日匠人只信大型水池若无桥梁后文", items=((5, passage, None),))
    assert not find("前文昔日匠人只信后文", items=((5, passage, None),))


def test_tables(spark):
    docs = spark.createDataFrame([(1, PASSAGE, 9), (1, PASSAGE, 9), (2, None, 9), (3, "", 9), (None, PASSAGE, 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, "wo", PASSAGE, "d"), (7, "wo", PASSAGE, "d"), (8, None, None, "d"), (9, "x", "", "d")], "item_id long, query string, passage string, text string")
    got = sorted(((r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()), key=str)
    assert got == [(1, 7), (1, 7), (None, 7)]
    blocks = leaks.find_leaks(docs, items.union(spark.createDataFrame([(10, "x", PASSAGE, "d")], items.schema)), part=10)
    assert sorted(((r.doc_id, r.item_id) for r in blocks.collect()), key=str) == sorted([(1, 7), (1, 7), (1, 10), (1, 10), (None, 7), (None, 10)], key=str)
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    # of two passages under one id each counts, the larger share is given
    two = spark.createDataFrame([(7, "x", "etwas ganz anderes " * 5, "d"), (7, None, PASSAGE, "d"), (8, None, PASSAGE + " und noch viel mehr", "d")], items.schema)
    for part in (10**6, 30):
        got = {(r.doc_id, r.item_id, round(r.share, 2)) for r in leaks.find_leaks(docs, two, part=part).collect()}
        assert got == {(1, 7, 1.0), (1, 8, 0.83), (None, 7, 1.0), (None, 8, 0.83)}
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0
    (item,) = leaks.leaked_items(leaks.find_leaks(docs, items)).collect()
    assert (item.item_id, item.n_docs, item.best_share) == (7, 1, 1.0)
