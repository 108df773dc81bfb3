import json

import pytest

from tributary.sources import html
from tributary.sources.adapters import ADAPTERS, override, registry, requests, with_language
from tributary.sources.pages import captured, extract_html, extract_json, page_errors, readable, register


def page(body):
    return f"<html><body>{body}</body></html>"


@pytest.fixture
def rows(spark):
    def run(shortcut, body):
        df = spark.createDataFrame([(1, ADAPTERS[shortcut].config.name, page(body))], "query_id long, engine string, body string")
        return [tuple(r)[2:] for r in extract_html(df).orderBy("pos").collect()]

    return run


def test_duckduckgo(rows):
    item = '<div class="result"><h2 class="result__title"><a href="{}">{}</a></h2>{}</div>'
    snippet = '<a class="result__snippet">A <b>bold</b> text</a>'
    two = item.format("https://a.com", "One", snippet) + item.format("https://b.com", "Two", "")
    assert rows("ddg", two) == [(1, "https://a.com", "One", "A bold text"), (2, "https://b.com", "Two", "")]
    wrapped = item.format("//duckduckgo.com/l/?uddg=https%3A%2F%2Fkettle.test%2Fold%3Fn%3D2&amp;u=9", "T", "")
    assert rows("ddg", wrapped) == [(1, "https://kettle.test/old?n=2", "T", "")]
    assert rows("ddg", item.format("", "T", "") + item.format("https://a.com", " ", "") + '<div class="result"></div>') == []


def test_brave(rows):
    one = '<div class="snippet" data-type="{}"><a href="{}"><span class="search-snippet-title">T</span></a><div class="generic-snippet"><p class="content">C</p></div></div>'
    assert rows("brave", one.format("web", "https://a.com") + one.format("video", "https://b.com") + one.format("web", "/local")) == [(1, "https://a.com", "T", "C")]


def test_sogou(rows):
    assert rows("sogou", '<div class="vrwrap"><h3 class="vr-title"><a href="/go?to=kettle">标题</a></h3><p class="str_info">内容</p></div>') == [(1, "https://www.sogou.com/go?to=kettle", "标题", "内容")]
    assert rows("sogou", '<div class="rb"><h3><a href="//h/x">t</a></h3></div>')[0][1] == "https://www.sogou.com//h/x"


def test_360(rows):
    item = '<li class="res-list"><h3><a href="https://away"{}>T</a></h3><p class="res-desc">C</p></li>'
    got = rows("360", "<ul>" + item.format(' data-mdurl="https://real"') + item.format("") + item.format(' data-mdurl=""') + "</ul>")
    assert [r[1] for r in got] == ["https://real", "https://away"]


def test_google(rows):
    item = '<div class="g"><a href="{}"><h3>T</h3></a><div {}>C</div></div>'
    body = item.format("/url?q=https://kettle.test/x&amp;ved=2", 'class="VwiC3b"') + item.format("/maps?near=kettle", "") + item.format("https://b.com", 'data-sncf="1"') + '<div class="g"><a href="https://c"></a></div>'
    assert rows("g", body) == [(1, "https://kettle.test/x", "T", "C"), (2, "https://b.com", "T", "C")]


def test_baidu_and_bing(rows):
    body = '<div class="result c-container"><h3><a href="https://a">中文</a></h3><div class="c-abstract">摘要</div></div><div class="result"><h3><a href="">x</a></h3></div>'
    assert rows("baidu", body) == [(1, "https://a", "中文", "摘要")]
    nested = '<div class="result"><div class="c-container"><h3><a href="https://a">t</a></h3></div></div>'
    assert len(rows("baidu", nested)) == 2
    body = '<ol><li class="b_algo"><h2><a href="https://a">T</a></h2><div class="b_caption"><p>C</p></div></li><li class="b_algo"><h2><a href="javascript:x">T</a></h2></li></ol>'
    assert rows("bing_cn", body) == [(1, "https://a", "T", "C")]


@pytest.mark.parametrize("shortcut", [k for k, a in ADAPTERS.items() if not a.json])
def test_empty_page(rows, shortcut):
    assert rows(shortcut, "") == []


def test_selectors():
    root = html.parse('<div class="a b"><p id=x><br>one<script>if (a<b) {}</script></p><span data-k="vv">two</span></div>')
    for selector, text in (("div.a.b p", "oneif (a<b) {}"), ('[data-k="vv"]', "two"), ('span[data-k^="v"]', "two"), ("em, span", "two"), ("[id]", "oneif (a<b) {}")):
        assert html.first(root, selector).text() == text
    assert html.first(root, ".c") is None and html.first(root, "p span") is None


def test_tables(spark):
    def wiki(q, body):
        return (q, "Wikipedia", body)

    hits = {"query": {"search": [{"title": "A b", "snippet": "<b>x</b> y", "pageid": 1}, {"title": "C", "snippet": "", "pageid": 2}]}}
    df = spark.createDataFrame([wiki(1, json.dumps(hits)), wiki(2, "{}"), wiki(3, '{"query":{"search":[]}}'), wiki(4, "no json"), wiki(5, None), (6, "Google", "recaptcha"), (7, "Google", page("")), (8, "Other", "x")], "query_id long, engine string, body string")
    got = [tuple(r) for r in extract_json(df).orderBy("pos").collect()]
    assert got == [(1, "Wikipedia", 1, "https://en.wikipedia.org/wiki/A_b", "A b", "x y"), (1, "Wikipedia", 2, "https://en.wikipedia.org/wiki/C", "C", "")]
    errors = {r.query_id: r.message for r in page_errors(df).collect()}
    assert set(errors) == {4, 5, 6} and "CAPTCHA" in errors[6]
    assert {r.query_id for r in readable(df).collect()} == {1, 2, 3, 7, 8}
    assert extract_html(df).count() == 0
    assert extract_html(df.limit(0)).count() == 0


def test_requests_and_registry(spark):
    q = spark.createDataFrame([(1, "rust lang")], "query_id long, query string")
    urls = {r.shortcut: r.request_url for r in requests(q).collect()}
    assert urls["g"] == "https://www.google.com/search?q=rust%20lang&hl=en"
    assert with_language(ADAPTERS["wiki"], "de").request.startswith("https://de.wikipedia.org/")
    reg = {r.shortcut: r for r in registry(spark, {**ADAPTERS, "g": override(ADAPTERS["g"], weight=3.0)}).collect()}
    assert (reg["wiki"].weight, reg["g"].weight, reg["g"].timeout) == (1.2, 3.0, 10)
    pages = spark.createDataFrame([(urls["g"], "old", 1, 2.0), (urls["g"], "new", 2, 30.0), (urls["brave"], "b", 1, 3.0)], "request_url string, body string, captured_at int, latency double")
    got = {r.shortcut: r.body for r in captured(requests(q), pages).collect()}
    assert (got["g"], got["brave"], got["ddg"], len(got)) == ("new", "b", None, 8)
    assert captured(requests(q), pages.select("request_url", "body")).count() == 8
    late = {r.engine: r.message for r in page_errors(captured(requests(q), pages)).collect()}
    assert late["Google"] == "timed out" and "Brave" not in late and late["DuckDuckGo"].startswith("HTTP request failed")


def test_a_second_json_source(spark):
    wiki = ADAPTERS["wiki"]
    own = {"wiki": wiki, "fr": override(with_language(wiki, "fr"), name="Wiki FR", shortcut="fr")}
    body = '{"query":{"search":[{"title":"La clé","snippet":"x","pageid":3}]}}'
    df = spark.createDataFrame([(1, "Wikipedia", body), (2, "Wiki FR", body)], "query_id long, engine string, body string")
    assert {r.query_id: r.url for r in extract_json(df, own).collect()} == {1: "https://en.wikipedia.org/wiki/La_clé", 2: "https://fr.wikipedia.org/wiki/La_clé"}
    assert extract_json(df, {"ddg": ADAPTERS["ddg"]}).count() == 0


@pytest.mark.parametrize(
    ("body", "n"),
    [
        ('{"query":{"search":[{"title":"T","snippet":"s","pageid":1,"size":9}]}}', 1), ("{}", 0), ('{"query":null}', 0), ('{"query":{"search":[]}}', 0),
        ('{"query":5}', None), ('{"query":{}}', None), ("[]", None), ('{"query":{"search":{}}}', None), ('{"query":{"search":[5]}}', None), ("", None), ("null", None),
        ('{"query":{"search":[{"title":"T","pageid":1}]}}', None), ('{"query":{"search":[{"snippet":"s","pageid":1}]}}', None),
        ('{"query":{"search":[{"title":1,"snippet":"s","pageid":1}]}}', None), ('{"query":{"search":[{"title":"T","snippet":null,"pageid":1}]}}', None),
        ('{"query":{"search":[{"title":"T","snippet":"s","pageid":-1}]}}', None), ('{"query":{"search":[{"title":"T","snippet":"s","pageid":1.5}]}}', None),
        ('{"query":{"search":[{"title":"T","snippet":"s","pageid":18446744073709551615}]}}', 1),
    ],
)
def test_json_answers_are_decoded_strictly(spark, body, n):
    df = spark.createDataFrame([(1, "Wikipedia", body)], "query_id long, engine string, body string")
    assert extract_json(df).count() == (n or 0)
    assert (page_errors(df).count(), readable(df).count()) == ((1, 0) if n is None else (0, 1))


def test_table_function(spark):
    register(spark)
    body = '<li class="b_algo"><h2><a href="https://a">T</a></h2></li>'
    spark.createDataFrame([(1, "Bing China", body), (2, "Bing China", None), (3, "Other", body)], "id int, engine string, body string").createOrReplaceTempView("captured")
    got = spark.sql("SELECT id, place, href, title FROM captured, LATERAL result_boxes(body, engine)").collect()
    assert [tuple(r) for r in got] == [(1, 1, "https://a", "T")]
