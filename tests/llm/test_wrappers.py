import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vaultlens.llm import wrappers
from vaultlens.llm import common
from vaultlens.llm.wrappers import expression, merge, packed, parse, text_of, unpacked, wrapper_of

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>
 word<br><p>Two&nbsp;&eacute;&#x41;<ul><li>x<li>y</ul><form><input value="q">Send</form><aside>side</aside></article>
<section id="comments"><p>first!</p></section><footer>&copy; us</footer></body></html>"""
TEXT = "Head & line\nOne bold word\nTwo éA\nx\ny"


def test_article_without_the_rest():
    assert text_of(PAGE, wrapper_of(parse(PAGE))) == TEXT
    assert text_of(PAGE) == TEXT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>cut off in <b>the mid", "cut off in the mid"),
        ("<div><p>a</div></p><p>b", "a\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
        ("<p>a < b &lt; c</p>", "a < b < c"),
        ("<main><article>x</article></main>", "x"),
        ("<main><header><h1>t</h1></header><p>x</p></main>", "t\nx"),
    ],
)
def test_markup(page, want):
    assert text_of(page, wrapper_of(parse(page))) == want == text_of(page)


@pytest.mark.parametrize("script", ["for(var i=0;i<n;i++)f(i);", "<!-- f();", "a<b&&c('\"');", "x='</scripted>';"])
@pytest.mark.parametrize("tag", ["script", "STYLE", "svg"])
def test_raw_content_is_no_markup(script, tag):
    raw = f"<{tag} class='x'>{script}</{tag} >"
    page = f"<html><head>{raw}</head><body>{raw}<article><p>one</p>{raw}<p>two</p></article><p>after</p>{raw}</body></html>"
    assert text_of(page, wrapper_of(parse(page))) == "one\ntwo" == text_of(page)


def test_raw_content_without_end():
    assert text_of("<article><p>one</p><script>if(i<n)</scrip") == "one"


def test_mismatches_become_optional_and_repeated():
    one = wrapper_of(parse("<div><h1>a</h1><p>b</p></div>"))
    merge(one, wrapper_of(parse("<div><h1>c</h1><ul><li>1</li><li>2</li></ul><p>d</p><p>e</p></div>")))
    assert expression(one) == "<#page><div><h1>#</><ul><li>#</>+</>?<p>#</>+</></>"
    assert expression(unpacked(packed(one))) == expression(one)
    rows = wrapper_of(parse("<dl><dt>a<dd>b<dd>c<dt>d<dd>e</dl>"))
    assert expression(rows) == "<#page><dl>(<dt>#</><dd>#</>+)+</></>"
    merge(rows, wrapper_of(parse("<dl><dt>a<dd>b</dl>")))
    assert expression(rows) == "<#page><dl>(<dt>#</><dd>#</>+)+</></>"


def pattern(part):
    """The wrapper as a pattern over a page's stream of element keys."""
    inner = "".join(map(pattern, part.parts))
    whole = inner if part.key[0] == "(" else f"<{re.escape(part.key)}>{inner}</>"
    return f"(?:{whole})" + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[part.optional, part.repeated]


def stream(node):
    return f"<{node.key}>" + "".join(stream(x) for x in node.parts if isinstance(x, wrappers.Node)) + "</>"


@given(st.lists(st.recursive(st.lists(st.sampled_from(["h2", "p", "ul", "hr"]), max_size=6), lambda x: st.lists(st.tuples(st.sampled_from(["div", "section"]), x), max_size=4), max_leaves=6), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_a_wrapper_matches_all_its_pages(trees):
    """Against brute force: as a pattern, the wrapper accepts the token stream of every page that it was aligned with."""

    def page(tree):
        return "".join(f"<{x}>x</{x}>" if isinstance(x, str) else f"<{x[0]}>{page(x[1])}</{x[0]}>" for x in tree)

    roots = [parse(page(t)) for t in trees]
    whole, *rest = map(wrapper_of, roots)
    for other in rest:
        merge(whole, other)
    for root in roots:
        assert re.fullmatch(pattern(whole), stream(root))
    assert expression(unpacked(packed(whole))) == expression(whole)


def test_names_that_say_more_than_boilerplate_stay():
    for name in ("post-header", "entry-header", "share-price", "related-work", "form-of-government"):
        assert text_of(f"<article><p>a</p><div class='{name}'><p>b</p></div></article>") == "a\nb"
    for name in ("related-posts", "share-buttons", "comment-list", "ad-slot", "newsletter", "sidebar left", "commentList"):
        assert text_of(f"<article><p>a</p><div class='{name}'><p>b</p></div></article>") == "a"


def test_deep_and_wide_pages():
    page = "<div>" * 5000 + "deep"
    whole = wrapper_of(parse(page))
    merge(whole, wrapper_of(parse(page + " too")))
    assert text_of(page, unpacked(packed(whole))) == text_of(page) == "deep"
    wide = [f"<article>{''.join(f'<p class=c{chr(97 + i % 26)}{chr(97 + (i * k) % 26)}{chr(97 + i // 26)}>{i}</p>' for i in range(400))}</article>" for k in (1, 3, 5, 7)]
    whole = wrapper_of(parse(wide[0]))
    for page in wide[1:]:
        merge(whole, wrapper_of(parse(page)))
    assert len(packed(whole)) < 20_000 and all(text_of(p, whole) == "\n".join(map(str, range(400))) for p in wide)


def test_the_wrapper_tells_boilerplate_from_text(spark):
    """Pages without telling tags or names: only what varies over the host's pages is text."""
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [[prose(12) for _ in range(rng.randrange(1, 4))] for _ in range(40)]
    page = lambda ps: f"<body><div class='aqua'><div>Home of all our news and views since long ago</div></div><div class='rose'>{''.join(f'<p>{p}</p>' for p in ps)}<div>Read on at our other place for more of this</div></div><div class='lime'><p>All of this belongs to us and nobody else at all</p></div></body>"
    df = spark.createDataFrame([(k, f"http://a.org/{k}", page(ps)) for k, ps in enumerate(texts)], "page_id long, url string, html string")
    want = ["\n".join(ps) for ps in texts]
    have = {r.page_id: r.text for r in wrappers.extracted(df).collect()}
    assert [have[k] for k in range(40)] == want
    assert not any(text_of(page(ps)) == w for ps, w in zip(texts, want))  # without the host's wrapper each has the rest in it


def test_wide_wrappers_are_joined_by_salt(spark):
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k}'}.org/{k}", f"<body><article><p>text {k}</p></article></body>") for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extracted(df, most=0).collect()} == {k: f"text {k}" for k in range(90)}
    table = df.groupBy(wrappers.host(df.url).alias("host")).agg(F.count("*").alias("n"))
    joined = common.salted(df.withColumn("host", wrappers.host(df.url)), table, ["host"], F.xxhash64("page_id"), 90, hot=10)
    assert joined.count() == 90 and sorted(joined.columns) == ["host", "html", "page_id", "url"]


def test_page_unique_ids_fold_into_one_part(spark):
    page = lambda k: f"<body><div id='ad{k}'>buy</div><article id='post-{k}' class='post-{k} post'><p id='x{k}f'>text {k}</p></article></body>"
    df = spark.createDataFrame([(k, f"http://a.org/{k}", page(k)) for k in range(300)], "page_id long, url string, html string")
    row = wrappers.wrappers(df).collect()[0]
    assert row.n == 300 and len(row.wrapper) < 500
    assert {r.page_id: r.text for r in wrappers.extracted(df).collect()} == {k: f"text {k}" for k in range(300)}


def test_hosts_without_article_use_what_all_pages_hold(spark):
    body = lambda k: f"<html><body><div class='top'>Links <a href='x'>a</a></div><div class='text'>{'<p>' + 'word ' * 40 + str(k) + '</p>'}</div><div class='side'>x</div></body></html>"
    rows = [(k, "http://a.org/" + str(k), body(k)) for k in range(30)] + [(50, None, PAGE), (51, "http://b.org", None), (52, "nonsense", ""), (53, "http://A.org/z", "<html><body><div class='text'>short</div></body></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as main", "3 as text", "4 as wrapper")
    found = {r.page_id: r for r in wrappers.extracted(df).collect()}
    assert len(found) == len(rows)
    assert all(found[k].text == "word " * 40 + str(k) and found[k].n_chars == len(found[k].text) for k in range(30))
    assert found[50].text == TEXT and found[51].text == "" and found[52].text == "" and found[53].text == "short"
    assert [r.host for r in wrappers.wrappers(df).filter("host = 'a.org'").collect()] == ["a.org"]


def test_none(spark):
    assert wrappers.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
