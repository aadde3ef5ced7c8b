import pytest
from pyspark.sql import functions as F

from lodestack.errors import ConfigError, SelectorError
from lodestack.functions import markup as M
from lodestack.sources.board_config import BoardConfig


def test_selector_specs():
    assert M.Selector.parse("h1::text") == M.Selector("h1", "text")
    assert M.Selector.parse("a.job::attr(href)") == M.Selector("a.job", "attr(href)")
    for bad in ("h1", "h1::nope", "::text", "a:hover::text", "a + b::text", "> a::text", "a >::text"):
        with pytest.raises(SelectorError):
            M.Selector.parse(bad)


def test_tree_repairs_and_selects():
    root = M.parse("<ul><li>a<li class='x y'>b<ul><li>c</ul></ul><p>one<p>two<div>three</div><table><tr><td>1<td>2<tr><td>3</table><img src=q><b>open &amp; <i>x")
    text = lambda css: [n.text() for n in root.select(css)]
    assert text("ul > li") == ["a", "bc", "c"] and text("li.x.y li") == ["c"] and text("p") == ["one", "two"]
    assert text("td") == ["1", "2", "3"] and text("tr") == ["12", "3"] and text("b") == ["open & x"] and text("p, i") == ["one", "two", "x"]
    assert len(root.select("[src]")) == 1 and len(root.select("img[src=q]")) == 1 and not root.select("img[src='z']") and len(root.select("*")) > 10
    assert M.parse("<div id=k><br/>a</div>").select("#k")[0].html() == '<div id="k"><br>a</div>'
    root.select("ul")[0].remove()
    assert not root.select("li")


def test_columns(spark):
    df = spark.createDataFrame([("<h1> A  b </h1><a href=''>x</a><a href=u>y</a>",), ("",), (None,)], "v string")
    got = df.select(M.extract_first(F.col("v"), "h1::text"), M.extract_all(F.col("v"), "a::attr(href)"), M.extract_first(F.col("v"), "h1::html")).collect()
    assert [tuple(r) for r in got] == [("A b", ["u"], "<h1> A b </h1>"), (None, [], None), (None, [], None)]


def test_board_config_is_strict():
    good = {"name": "b", "start_urls": ["http://x/j?p=1"], "list": {"item_selector": "div", "url": "a::attr(href)"}}
    config = BoardConfig.from_mapping(good)
    assert config.page_url(1) == "http://x/j?p=1" and config.base == "http://x/j?p=1"
    with pytest.raises(ConfigError):
        config.page_url(2)
    assert BoardConfig.from_mapping(good | {"pagination": {"page_query_param": "p"}}).page_url(3) == "http://x/j?p=3"
    assert BoardConfig.from_mapping(good | {"pagination": {"page_url": "/j/{page}"}}).page_url(2) == "http://x/j/2"
    for bad in ({"extra": 1}, {"start_urls": []}, {"list": {"item_selector": "div"}}, {"list": good["list"] | {"typo": 1}}, {"pagination": {"max_pages": 0}}, {"list": good["list"] | {"url": "a"}}):
        with pytest.raises(ConfigError):
            BoardConfig.from_mapping(good | bad)
    with pytest.raises(ConfigError):
        BoardConfig.from_mapping(["no"])
