import re
import unicodedata

import pytest

from tributary.llm import lookalikes as la

COUNTS = {c: 1000 for c in map(chr, range(32, 0x2FF))} | {c: 900 for c in map(chr, range(0x400, 0x460))}


@pytest.fixture(scope="module")
def form():
    return la.Canonicaliser(COUNTS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｐｉｐｅｔｔｅ １８", "Pipette 18"),
        ("café", "café"),
        ("ｃａｆｅ́", "café"),
        ("coﬃn ﬁlm ĳs", "coffin film ijs"),
        ("zero​width soft­hyphen ﻿bom", "zerowidth softhyphen bom"),
        ("no break thin space", "no break thin space"),
        ("USB‑C", "USB-C"),
        ("pаinted Тöpfe sοcket", "painted Töpfe socket"),
        ("наxодит oбзоp", "находит обзор"),
        ("⽕炉 ⽉台", "火炉 月台"),
        ("𝐛𝐨𝐥𝐝 ⓐⓑ", "bold ab"),
        ("Tụ̂", "Tụ̂"),
        ("é​́".replace("é", "e"), "é"),
    ],
)
def test_rewritten(form, text, want):
    assert form(text) == unicodedata.normalize("NFC", want)
    assert re.search(form.candidate_pattern(), text)
    assert form(form(text)) == form(text)


def test_letters_of_other_alphabets(form):
    for text, want in (("pαper", "paper"), ("sτone", "stone"), ("cοde", "code"), ("cօde", "code"), ("Ꭱoad", "Road"), ("pά per", "pá per"), ("pάper", "páper"), ("ѐtage", "ètage"), ("моpe", "море"), ("ⲞΚ", "ΟΚ")):
        assert form(text) == want, text
        assert form(form(text)) == form(text)
        assert form(text) == text or re.search(form.candidate_pattern(), text)
    # transitive: Greek and Cyrillic letters meet in a Latin one
    assert form.across["о"]["GREEK"] == "ο" and form.across["ο"]["CYRILLIC"] == "о"
    # no look-alike: the word is found all the same
    assert form("flжf") == "flжf" and form.mixed_words("a flжf") == [(2, 6, "LATIN")]
    # letters that all have look-alikes: the text around decides
    assert form("Ηοw the kettle boils") == "How the kettle boils"
    assert form.mixed_words("Wort слово αβγ 温a кабель-USB") == []


@pytest.mark.parametrize(
    "text",
    ["“quoted” – dash — …", "5 m² ½ № 7 ™ ®", "你好，世界！（好）", "👩‍🌾 ☕️", "USB-кабель и Dusku", "茶壶Vasda清理", "Größe naïve ção", "Привет мир", ""],
)
def test_ordinary(form, text):
    assert form(text) == text


def test_representative_is_the_most_frequent():
    apart = la.Canonicaliser(COUNTS | {"é": 10**6})
    assert apart("café") == "café"


def test_union_find_is_transitive():
    sets = la.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        sets.union(a, b)
    assert sorted(map(sorted, sets.classes())) == [["a", "b", "c", "d"], ["x", "y"]]


def test_tables(spark):
    rows = [(1, "ｆull", "plain", 5), (1, "ｆull", "plain", 5), (2, None, "", 5), (3, "ok – “fine”", "café", 5)] + [(9, "full café", "é", 5)] * 3
    df = spark.createDataFrame(rows, "result_id long, title string, content string, value int")
    got = sorted(tuple(r) for r in la.find_unusual(df).collect())
    assert got == [(1, "title", "full"), (1, "title", "full"), (3, "content", "café")]
    assert la.find_unusual(df.limit(0)).count() == 0
