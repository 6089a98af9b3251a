import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark import config
from docspark.functions import dom, image, path, tags, text, url
from docspark.functions.markdown import markdown

L = F.lit


@pytest.mark.parametrize(("given_url", "wanted"), [
    ("https://h/a/?utm_source=f&page=2&ref=x#t", "https://h/a?page=2"), ("https://h/", "https://h/"), ("https://h/a?x", "https://h/a"),
    ("https://h/a?k=1&k=2&m=3", "https://h/a?k=2&m=3"), ("https://h/a?a=1=2", "https://h/a?a=1=2"), ("https://h", "https://h"),
])
def test_normalize(value, given_url, wanted):
    assert value(url.normalize(L(given_url))) == wanted


@pytest.mark.parametrize("href", ["/x", "x", "#t", "?q=1", "//o/x", "http://o/x", "mailto:a@b", ""])
def test_absolute_is_rfc_join(spark, href):
    base = "https://h/a/b?c=d"
    row = spark.createDataFrame([(base, href)], "b string, h string").select(url.absolute(F.col("b"), F.col("h")), url.join("b", "h")).first()
    assert row[0] == row[1]


def test_null_urls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "u string").select(url.normalize(F.col("u")), url.host(F.col("u")), url.product(F.col("u")), url.join("u", "u")).first()
    assert list(row) == [None] * 4


def test_product_and_priority(value):
    assert value(url.product(L("https://h/some-cloud/docs/x"))) == "some-cloud" and value(url.product(L("https://h/"))) == ""
    assert [value(url.priority(L(u))) for u in ("https://h/get-started-x", "https://h/install-y", "https://h/basics", "https://h/tutorial", "https://h/z")] == [1, 2, 3, 4, 5]


def test_domain_modes(value):
    root, base = "https://h/", "https://h/p"
    assert [value(url.allowed(L(u), m, root, base)) for m in ("off", "any", "product", "odd") for u in ("https://h/p/x", "https://h/q", "https://o/")] == [True] * 3 + [True, True, False] + [True, False, False] * 2
    assert value(url.sitemap_wanted(L("https://h/p/docs/x"), "product", root, base)) and not value(url.sitemap_wanted(L("https://h/p/docs/x"), "odd", root, base))
    assert value(url.is_documentation(L("https://h/p/x"), base)) and not value(url.is_documentation(L("https://h/p/x.PDF"), base))


@pytest.mark.parametrize(("a", "b", "wanted"), [
    ("docs/Getting started/page1.md", "docs/Getting started/page2", "page2"), ("docs/Getting started/page1.md", "docs/Getting started/Advanced/page2", "Advanced/page2"),
    ("docs/Getting started/Advanced/page1.md", "docs/Getting started/page2", "../page2"), ("docs/Getting started/page1.md", "docs/Configuration/page2", "../Configuration/page2"),
    ("docs/Getting started/Advanced/Deep/page1.md", "docs/Configuration/page2", "../../../Configuration/page2"),
])
def test_relative(value, a, b, wanted):
    assert value(path.relative(L(a), L(b))) == wanted


def test_names(value):
    assert value(path.slug_title(L("what-is-a-service-project"))) == "What is a Service Project"
    assert value(path.slug_title(L("iPhone-OS"))) == "Iphone Os"
    assert value(path.safe_name(L("a/b: c?  d."))) == "a-b c d" and len(value(path.safe_name(L("x" * 300)))) == 100
    assert value(path.escapes(L("a/../../b"))) and not value(path.escapes(L("a/../b")))
    none = L(None).cast("array<string>")
    place = lambda u: tuple(value(path.file_place(L(u), none, L(None).cast("string"), L(None).cast("string"), L(False))))
    assert place("https://h/p/docs/getting-started") == ("docs", "Getting Started.md") and place("https://h/p/docs/") == ("docs", "index.md")
    assert "?" not in place("https://h/p/docs/x?")[1]


def test_images(value):
    kind = lambda hexed, ctype: value(image.extension(F.unhex(L(hexed)), L(ctype)))
    assert kind("00", "image/svg+xml") == ".svg" and kind("89504E470D0A1A0A00000000", None) == ".png" and kind("89504E470D0A1A0A", None) is None
    assert value(image.refusal(L("ftp"), L(1))) == "unsupported scheme" and value(image.refusal(L("https"), L(1))) is None


@pytest.mark.parametrize(("t", "wanted"), [("Service Project Configuration", "service-project-configuration"), ("User & Team Management", "user-team-management"), ("API/REST Reference", "api-rest-reference"), ("  Spaces  Around  ", "spaces-around"), ("Multiple---Hyphens", "multiple-hyphens"), ("", ""), ("123-Numbers-456", "123-numbers-456")])
def test_tag(value, t, wanted):
    assert value(text.tag(L(t))) == wanted


def test_hierarchical_tags(value):
    none = L(None).cast("array<string>")
    assert "user-management" in value(tags.hierarchical(L("x-cloud"), L("Manage users in your team"), L("User Management"), none))
    assert value(tags.hierarchical(L("c"), L("REST API Reference"), L("Developer Resources"), none))[:2] == ["c", "api"]
    assert value(tags.hierarchical(L("s"), L("Getting Started"), L(""), none)) == ["s", "getting-started"]


def test_text(value):
    assert value(text.yaml_list_gap(L("tags:\n\n- a\n\n- b"))) == "tags:\n- a\n\n- b"
    assert value(text.without_h1(L("# A\nb\n# C\nd"))) == "b\nd"
    base = "https://h/p"
    assert value(text.wikilinks(L("[T](https://h/p/docs/change-x/) ![i](https://h/p/resources/y)"), base)) == "[[change-x|T]] ![[resources/y|i]]"
    html = "<script>window.S = /* c */ {\"a\": \"b\"};</script>"
    assert value(text.initial_state(L(html), "S")) == '{"a": "b"}' and value(text.initial_state(L(html), "S", comments=False)) is None
    assert value(text.initial_state(L('window.S = {"a": "};"};'), "S")) is None


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_idempotent(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    twice = rows.select(text.tag(F.col("t")).alias("a"), text.tag(text.tag(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in twice)


def test_tree_rules():
    root = dom.parse("<div class='a b'><p><b>x<br><p>y</div></i><img src=u>z")
    assert [n.tag for n in root.walk()] == ["div", "p", "b", "br", "p", "img"]
    assert dom.first(root, ".b").text() == "xy" and dom.first(root, 'img[src="u"]') and dom.first(root, "#none,[src]").tag == "img"
    assert dom.parse("").text() == "" and dom.parse("<script>a</p>b</script>").text() == "a</p>b"


def test_markdown():
    told = markdown(dom.parse("<h1>T</h1><p>a <strong>b</strong> <em>c</em> <a href='u'>d</a></p><ul><li>Item 1</li><li>x<ul><li>y</li></ul></li></ul><pre>k\n l</pre><table><tr><th>h</th></tr><tr><td>1</td></tr></table>"))
    assert told.startswith("# T\n\na **b** *c* [d](u)") and "- Item 1" in told and "```\nk\n l\n```" in told and "| h |\n| --- |\n| 1 |" in told
    assert "x" in markdown(dom.parse("<div>" * 3000 + "x"))


def test_config():
    got, wrong = config.from_environment({"DOCSPARK_WORKERS": "90", "DOCSPARK_MAX_RETRIES": "2", "DOCSPARK_DOMAIN_RESTRICTION": "strict"})
    assert got.workers == 5 and got.max_retries == 2 and got.domain_restriction == "product" and len(wrong) == 1
