import hashlib
import random
import re

import pytest

from palimpsest.llm import html_extract as H
from palimpsest.llm import warc

PAGES = "page_id BIGINT, url STRING, html STRING, text STRING, plan STRING, host STRING"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


@pytest.mark.parametrize("html,want", [
    ("<article><h1>T &amp; U</h1><p>one<br>two <b>three</b>&nbsp;four</p><p>five</article>", "T & U\none two three four\nfive"),
    ("<nav>menu</nav><article><p>a</p><aside>side</aside><div class='ad'>buy</div><form>q</form><p>b<script>if (a<b) x('</p>')</script></p><section id=comments><p>nice</section></article><footer>f</footer>", "a\nb"),
    ("<header>top</header><main><p>x &lt;b&gt; &#x41;&eacute; &copy</main><div>more</div>", "x <b> Aé ©"),
    ("<body><div class='cookie-notice'>ok?</div><div class='post-content'><p>text<ul><li>i<li>j</ul></div><div role=contentinfo>c</div>", "text\ni\nj"),
    ("<article>a < b and 3<4 <!-- <p>no</p> --> e<![CDATA[x]]></article>", "a < b and 3<4 e"),
    ("<article><p>open <b>bold<br><p>next</article></p>", "open bold\nnext"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    ("<p>plain", "plain"),
    ("just text", "just text"),
    ("<p title='a>b'>q</p><p hidden>h</p><p style='display: none'>n</p>", "q"),
    ("", ""), (None, ""), ("<", "<"), ("<script>never closed", ""), ("<!-- open", ""),
])
def test_extract(html, want):
    assert H.extract(html) == want


def test_wrapper_finds_the_article_without_marks():
    page = "<html><body><div class='x1'><a href=/>Home</a> <a href=/b>B</a></div><div class=y>%s</div><div class=z>All rights kept</div></body></html>"
    made = [page % ("<h2>Title %d</h2>" % i + "<p>a paragraph of page %d that is long enough</p>" % i * (i + 1)) for i in range(6)]
    w = H.Wrapper()
    for p in made:
        w.add_page(p)
    assert w.expression() == "<html><body><div.x1># </> <div.y><h2># </> <p># </>+</> <div.z># </></></>"
    assert H.extract(made[2], w.plan()) == "\n".join(["Title 2", *["a paragraph of page 2 that is long enough"] * 3])
    parts = [H.Wrapper(), H.Wrapper()]
    for i, p in enumerate(made):
        parts[i % 2].add_page(p)
    total = H.Wrapper.loads(parts[1].dumps())
    total.merge(H.Wrapper.loads(parts[0].dumps()))
    assert total.plan() == w.plan() and total.expression() == w.expression()


@pytest.mark.parametrize("copies", [1, 2, 3, 40])
def test_copies_show_no_template(spark, copies):
    page = "<body><div class=x><h2>Title %d</h2><p>a paragraph of page %d</p></div><footer>seen %d times</footer></body>"
    rows = [(i, f"http://h.example.com/{i}", page % (1, 1, i)) for i in range(copies)] + [(100 + i, None, page % (2, 2, i)) for i in range(copies)]
    got = {r.page_id: r.text for r in H.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Title {n}\na paragraph of page {n}" for i, n in ((i, 1 if i < 100 else 2) for i, _, _ in rows)}


def test_copies_beside_different_pages():
    page = "<body><div class=y><p>words of page %d</p></div><div class=z>All rights kept</div></body>"
    w = H.Wrapper()
    for n in [0] * 5 + [1, 2]:
        w.add_page(page % n)
    assert H.extract(page % 0, w.plan()) == "words of page 0"
    w.tree = None  # what the wrapper knows is what decides
    assert H.extract(page % 0, w.plan()) == "words of page 0\nAll rights kept"


def unmarked_site(rng, pages):
    """Pages without an article element, and with names that mislead; (html, its article's blocks)."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "cloud", "field", "winter", "lamp", "paper", "north"]) + str(rng.randrange(50)) for _ in range(n))
    shape = rng.choice(["plain", "table", "comments", "search-results"])
    named = rng.random() < 0.6  # else no element has a class
    out = []
    for i in range(pages):
        blocks = [f"Title {i} {words(4)}"] + [words(rng.randint(15, 40)) for _ in range(rng.randint(3, 7))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        body = {"plain": f"<div class=c1>{body}</div>", "table": f"<table><tr><td>{body}</td></tr></table>", "comments": f"<div class=comments-on-science>{body}</div>", "search-results": f"<div class='search-results'>{body}</div>"}[shape]
        menu = "".join(f"<li><a href=/{x}>{words(1)}</a></li>" for x in range(rng.randint(3, 6)))
        notice = "<div class=c7>We use your data as the law permits, see our terms for more on that.</div>" if rng.random() < 0.9 else ""
        related = "<div class=c8>" + "".join(f"<a href=/r{x}>{words(3)}</a> " for x in range(4)) + "</div>"
        out.append((f"<html><body><div class=c3><ul>{menu}</ul></div>{notice}{body}{related}<div class=c9>All rights kept by the site</div></body></html>", blocks))
        if not named:
            out[-1] = (re.sub(r" class=('[^']*'|[^ >]*)", "", out[-1][0]), blocks)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_unmarked_sites_against_what_they_were_made_of(seed):
    site = unmarked_site(random.Random(seed), 12)
    w = H.Wrapper()
    for page, _ in site:
        w.add_page(page)
    plan = H.Wrapper.loads(w.dumps()).plan()
    for page, blocks in site:
        assert H.extract(page, plan) == "\n".join(blocks)


@pytest.mark.parametrize("html,want", [
    ("<article><p>text of it</p><p class=comment>nice one</p></article>", "text of it"),
    ("<article><h1>T</h1><div class='search-results'><p>a text</p><p>more</p></div></article>", "T\na text\nmore"),
    ("<article><div class='social-science'><p>all of the text</p></div></article>", "all of the text"),
    ("<article><p>x</p><div class='comments'><p>" + "long reader comment " * 3 + "</p></div><p>" + "long text " * 20 + "</p></article>", "x\n" + " ".join(["long text"] * 20)),
])
def test_names_only_hint(html, want):
    assert H.extract(html) == want


@pytest.mark.parametrize("depth", [99, 101, 1100, 10_000])
def test_deep_nesting(depth):
    page = "<div>" * depth + "<article><p>deep text</p></article>" + "</div>" * depth + "<footer>f</footer>"
    w = H.Wrapper()
    for _ in range(3):
        w.add_page(page)
    assert H.extract(page, H.Wrapper.loads(w.dumps()).plan()) == "deep text" == H.extract(page)


def test_a_wrapper_is_bounded(monkeypatch):
    monkeypatch.setattr(H, "NODES", 60)
    monkeypatch.setattr(H, "CELLS", 100)
    w, made = H.Wrapper(), []
    for i in range(30):
        made.append("<body><nav>m</nav><article>" + "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + j)}><p>part {i} {j}</p></div>" for j in range(20)) + "</article></body>")
        w.add_page(made[-1])
    assert H._size(w.tree) <= 60
    for i, page in enumerate(made):
        assert H.extract(page, w.plan()) == "\n".join(f"part {i} {j}" for j in range(20))


def test_a_very_long_page(spark):
    body = "".join(f"<p>paragraph {i} of a long page</p>" for i in range(30_000))
    (row,) = H.main_text(pages(spark, [(1, "http://a.example.com/", f"<article>{body}</article>")])).collect()
    assert row.text.count("\n") == 29_999


def test_wrapper_optional_and_groups():
    w = H.Wrapper()
    w.add_page("<body><dl><dt>a<dd>b<dt>c<dd>d</dl><h1>t</h1></body>")
    w.add_page("<body><dl><dt>a<dd>b</dl></body>")
    text = w.expression()
    assert "<h1># </>?" in text and "(<dt># </> <dd># </>)+" in text


def test_main_text(spark):
    body = "<head><title>t</title></head><nav><ul><li><a>m</a><li><a>n</a></ul></nav><article><h1>T%d</h1><p>page %d</p></article><footer>f</footer>"
    rows = [(i, f"http://h{i % 3}.example.com/{i}", body % (i, i)) for i in range(40)] + [(100, None, body % (1, 1)), (101, "http://[bad", "<p>x"), (102, "", None), (0, "http://h0.example.com/0", body % (0, 0)), (None, "http://h.example.com", "")]
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in H.main_text(pages(spark, rows)).collect())
    assert got == sorted((str(i), str(u), t := H.extract(h), len(t)) for i, u, h in rows)
    assert H.main_text(pages(spark, [])).count() == 0


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 600
    rows = [(1, "http://a.b.com/x?y=1", long), (5, "http://a.b.com/x?y=1", long), (3, None, long), (2, "http://c.com", "<p>s"), (4, "http://c.com", "<p>s"), (6, "bad url\r\nX: y", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" * 100), (8, "u", "WARC/1.1\r\n\r\n" * 100), (None, "v", long)]
    got = sorted(((r.page_id or -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages(spark, rows)).collect())
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "").encode() == p and j is not None), default=None)
        again = len(p) >= 1000 and i != top
        want.append((i or -1, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


def test_warc_index(spark, monkeypatch):
    assert warc.url_key("http://www.Example.com:8080/a/b?q=1#f") == "com,example,www:8080)/a/b?q=1"
    assert warc.url_key("http://example.com") == "com,example)/" and warc.url_key("nothing") == "nothing" and warc.url_key(None) == ""
    rng = random.Random(1)
    rows = [(i, f"http://s{rng.randrange(9)}.example.org/{rng.randrange(150)}", f"<p>{i}") for i in range(2500)]
    monkeypatch.setattr(warc, "BLOCK_LINES", 100)
    records, root = warc.archive(spark, pages(spark, rows).repartition(3))
    assert root.agg({"n": "sum"}).first()[0] == 2500 and warc.blocks(root).count() == root.agg({"blocks": "sum"}).first()[0] >= 25
    assert warc.read_archives(root).rdd.getNumPartitions() == warc.blocks(root).count()
    assert sorted(r.page_id for r in warc.read_archives(root).collect()) == list(range(2500))
    for url in (rows[0][1], rows[77][1], "http://none.example.org/"):
        found = warc.lookup(root, url)
        assert [int(h["X-Page-Id"]) for h, _ in found] == sorted(i for i, u, _ in rows if u == url)
        assert all(b.endswith(f"<p>{h['X-Page-Id']}".encode()) for h, b in found)
    assert records.count() == 2500
