import pytest
from pyspark.sql import functions as F

from tributary import present
from tributary.functions import text as fx


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalized_url(spark):
    cases = {
        "https://Example.COM/Path/": "example.com/path", "http://Example.COM/Path/": "example.com/path", "example.com/path": "example.com/path",
        "https://example.com/": "example.com", "HTTPS://X.com/": "https://x.com", "https://https://a": "a", "http://https://a": "https://a",
        "https://http://a/": "a", "https://": "", "": "", "//x/": "//x",
    }
    assert run(spark, fx.normalized_url, list(cases)) == list(cases.values())
    assert run(spark, fx.normalized_url, [None]) == [None]


def test_strip_tags(spark):
    cases = {"<b>bold</b> text": "bold text", "<a><b>nested</b></a>": "nested", "<br><hr>": "", "Hello <b>world": "Hello world", "a > b": "a  b", "a < b <i>c": "a c", "x <unclosed": "x "}
    assert run(spark, fx.strip_tags, list(cases)) == list(cases.values())


def test_url_encode(spark):
    assert run(spark, fx.url_encode, ["a b+c*~", "é/?", "-_.~"]) == ["a%20b%2Bc%2A~", "%C3%A9%2F%3F", "-_.~"]


def test_redirect_target(spark):
    p = "//duckduckgo.com/l/?uddg="
    cases = {
        p + "https%3A%2F%2Fkettle.test%2Fold&u=9": "https://kettle.test/old", p + "https%3A%2F%2Fa%3Fx%3D1%26y": "https://a?x=1",
        "https://plain.example/?a=1&b": "https://plain.example/?a=1&b", p + p + "a%20b": "a b", p + "100%+x": "100%+x", p + "bad%FF&x": "bad%FF",
        "//duckduckgo.com/l/?u=1&uddg=x": "//duckduckgo.com/l/?u=1",
    }
    assert run(spark, fx.redirect_target, list(cases)) == list(cases.values())


def test_links(spark):
    cases = {"/url?q=https://e.com/p&sa=U": "https://e.com/p", "/search?q=x": None, "/url?x=1": "/url?x=1", "https://e.com": "https://e.com", "": ""}
    assert run(spark, fx.result_link, list(cases)) == list(cases.values())
    assert run(spark, lambda c: fx.absolute_link(c, "https://h"), ["/link?x", "//h2/x", "http://y"]) == ["https://h/link?x", "https://h//h2/x", "http://y"]
    assert run(spark, lambda c: fx.preferred_link(c, F.lit("second")), ["", None, "m"]) == ["", "second", "m"]
    assert run(spark, lambda c: fx.article_url(c, "https://en.wikipedia.org/wiki/{title}"), ["A b c"]) == ["https://en.wikipedia.org/wiki/A_b_c"]


@pytest.mark.parametrize("text", ["hello", "a" * 150, "a" * 200, "中" * 100, "a中b" * 60, "", "🦀" * 50])
def test_truncate(spark, text):
    want = text if len(text.encode()) <= 150 else "".join(c for i, c in enumerate(text) if len(text[:i].encode()) < 150) + "..."
    assert run(spark, lambda c: fx.truncate_bytes(c, 150), [text]) == [want]
    assert present.shorten(text, 150) == want


def test_blank(spark):
    assert run(spark, fx.is_blank, ["   ", "\t\n  ", "　", "​", "x", ""]) == [True, True, True, False, False, True]


def test_scores_round_by_their_exact_value(spark):
    import random

    rng = random.Random(4)
    values = [0.125, 0.375, 0.145, 2.675, 1.005, 0.0, 5.4, -0.125, -2.675, 99.995, 123456.785, 1e15, 0.005, 0.015, 1 / 3] + [rng.randint(0, 10**6) / 1000 for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r.x for r in df.select("i", fx.score_text(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_error_texts(spark):
    from tributary import model

    df = spark.createDataFrame([("HttpError", "x"), ("SearchTimeout", "x"), ("UrlError", None), ("other", "x")], "kind string, detail string")
    got = [r.x for r in df.select(fx.error_text(F.col("kind"), F.col("detail")).alias("x")).collect()]
    assert got == [str(model.HttpError("x")), str(model.SearchTimeout()), str(model.UrlError("")), None]
