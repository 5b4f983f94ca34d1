"""Main texts of generated sites, whose articles are known, and of markup that is broken, empty, long or deep."""

import html as reference
import random

import pytest

pytest.importorskip("patchlens.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from patchlens.llm import html, queries  # noqa: E402

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple oak pine rowan spruce teak willow yew".split()


def sentence(r, n=9):
    return " ".join(r.choices(WORDS, k=n)).capitalize() + "."


def article(r):
    """Blocks, and their markup."""
    blocks = [sentence(r, 4), *(sentence(r, r.randrange(5, 30)) + r.choice(["", " a < b & c", " éü “so”"]) for _ in range(r.randrange(3, 8)))]
    def shown(b):
        w = reference.escape(b).split(" ")
        w[len(w) // 2] = f"<b>{w[len(w) // 2]}</b>"
        return r.choice([" ", "\n  ", "&#32;"]).join(w)
    return blocks, f"<h1>{shown(blocks[0])}</h1>" + "".join(f"<p>{shown(b)}{r.choice(['', '</p>'])}" for b in blocks[1:])


def page(r, style, n):
    """A page of a site whose furniture has telling names ('named'), or none: only that it recurs tells what it is ('plain', without an article element too)."""
    blocks, body = article(r)
    own = random.Random(style)
    menu, legal, notice, aside = (sentence(own, k) for k in (5, 8, 12, 15))
    advert, comment = sentence(r), sentence(r)
    if style == "named":
        made = f"""<!DOCTYPE html><html><head><title>{blocks[0]}</title><script>if (a < b) x = "</p>";</script><style>p > a {{}}</style></head><body class="has-sidebar">
<header><a href="/">{menu}</a></header><div id="cookieNotice">{notice}</div><nav><ul><li>{sentence(r, 1)}<li>{menu}</ul></nav><div class="ad-slot">{advert}</div><div class="sidebar">{aside}</div>
<div class="layout with-sidebar"><article class="post comments-open">{body}<div class="share">Share this</div><form><input value=x>{sentence(r)}</form><aside>{sentence(r)}</aside></article>
<section id="comments"><article class="comment"><p>{comment}</p></article></section></div><footer>&copy; {legal}</footer><!-- {advert} --></body></html>"""
    elif style == "article":
        made = f"<div>{menu}</div><div>{notice}</div><article>{body}<div>{aside}</div><article>{comment}</article></article><div>{legal}</div>"
    else:
        made = f"<html><body><div><div>{menu}</div><table><tr><td>{notice}</td></tr></table></div><div>{body}</div><p>{legal}</p></body></html>"
    return n, f"http://{style}.example.com/{n}", made, "\n".join(" ".join(b.split()) for b in blocks)


SITES = [page(random.Random(7 * n + k), style, 100 * k + n) for k, style in enumerate(("named", "article", "plain")) for n in range(40)]
SCHEMA = "page_id bigint, url string, html string, text string, host string, templates int"


def table(spark, rows):
    return spark.createDataFrame([(*r[:3], "x", "y", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_sites(spark, threshold):
    """Templates are broadcast, or shuffled with the pages."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.page_id: r.text for r in html.extract(table(spark, SITES)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for n, _, _, want in SITES:
        assert got[n] == want


def test_templates_are_counted_as_by_hand(spark):
    want = {}
    for _, url, made, _ in SITES:
        own = html.Page(made)
        for h in own.counted():
            want.setdefault(("".join(url.split("/")[2:3]), h), set()).add(own.text())
    want = {k for k, mains in want.items() if len(mains) >= 3}
    got = html.site_templates(table(spark, SITES + SITES[:40])).select("host", F.explode("templates")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_copies_keep_their_article(spark):
    """Copies of one page on a host, exact and nearly so, are no template of each other, with an article element or without."""
    r = random.Random(1)
    blocks = [sentence(r, 20) for _ in range(8)]
    rows = []
    for n in range(60):
        own = blocks if n % 2 else [*blocks[:-1], sentence(r, 20)]
        body = "".join(f"<p>{b}</p>" for b in own)
        rows.append((n, "http://copies.example.com/", f"<article>{body}</article>" if n < 30 else f"<div>{body}</div>", "\n".join(own)))
    got = {r.page_id: r.text for r in html.extract(table(spark, rows)).collect()}
    assert all(got[n] == want for n, _, _, want in rows)


@pytest.mark.parametrize("made, want", [
    ("", ""), ("text", "text"), ("<p>a<p>b", "a\nb"), ("<div>a<br>b<hr>c</div>", "a b\nc"), ("a&amp;b &am &amp c&nbsp;d &#x41;&#0;", "a&b &am & c d A�"),
    ("<script>x<p>y</script>z", "z"), ("<script>never ends <p>x", ""), ("<p>a <3 b</p>", "a <3 b"), ("<p title='a>b'>c</p>", "c"), ("<p>a<!-- > b --!>c<!-->d", "acd"), ("<p>a<a href=\"x", "a"),
    ("<head><title>t</title><p>a", "a"), ("<b>a<p>b</b>c</p>", "a\nbc"), ("</div></p>a</b>", "a"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<main><h1>t</h1>x</main>y", "t\nx"), ("<article>a<article>comment</article>b</article>c", "a\nb"), ("<article><header><h1>t</h1></header>x<footer>f</footer></article>", "t\nx"),
    ("<div hidden>a</div><div style='display: none'>b</div><div role=navigation>c</div>d", "d"), ("<DIV CLASS=\"SideBar\">a</DIV>b b b", "b b b"), ("<article>a</article><article>b</article>", "a\nb"),
    ("<pre>a\n  b</pre> ", "a b"), ("a\ud800b".encode("utf-8", "replace").decode(), "a?b"), ("<!DOCTYPE html><?xml x?>a</ b>c", "ac"), ("<p>a<wbr>b</p>", "ab"),
])
def test_markup(made, want):
    assert html.Page(made).text() == want


def test_large_pages_take_linear_time():
    deep = 100_000
    assert html.Page("<div>" * deep + "a").text() == "a"
    assert html.Page("<span>" * deep + "<hr>" * deep + "a" + "</i>" * deep).text() == "a"
    assert html.Page("<a href=\"" * deep).text() == ""
    assert html.Page("<!--" * deep + "<" * deep).text() == ""
    assert len(html.Page("<p>" + "word & " * 500_000).text()) == 3_499_999
    assert html.Page("<p><b>x" * deep).text().count("\n") == deep - 1


def test_query_and_edges(spark, tmp_path):
    rows = [*SITES, *SITES[:2], (900, None, "<p>a</p>", "a"), (901, "no host", "<nav>m</nav>b", "b"), (902, "http://x.example", None, ""), (None, "HTTP://u:p@X.example:80/y", "<div></div>", ""), (903, "", "", "")]
    table(spark, rows).select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_site_templates(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((n, url, want, len(want))) for n, url, _, want in rows)
    hosts = [r[0] for r in table(spark, rows[-5:]).orderBy("page_id").select(html.host_of(F.col("url"))).collect()]
    assert hosts == ["x.example", None, None, "x.example", None]
    assert html.extract(table(spark, rows[:1]).limit(0)).count() == 0
