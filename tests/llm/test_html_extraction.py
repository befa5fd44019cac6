import math
import random
import time
from collections import defaultdict

import pytest

from motifspark.llm.html_extraction import GAMMA, LEAST_PAGES, LEAST_IMPORTANCE, Page, extract, leaf, style_trees, text_of


def test_article_text():
    html = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One  <i>t</i>wo<br>three<p>Four &lt; five<aside>side</aside>
    <div class="cookie-notice">Cookies</div><form>Mail</form><p>Six</article><div id="comments"><article>Comment</article></div><footer>&copy; x</footer>"""
    assert text_of(html, set()) == "Head & line One two three Four < five Six"
    assert text_of("", set()) == "" and text_of("plain &eacute; text", set()) == "plain é text"


def test_template_blocks_go_and_copies_stay(spark):
    rows = [(i, "http://a.b/x", f"<body><div class=x>Always the same</div><div class=y>Text {i}</div>") for i in range(30)]
    rows += [(100 + i, "http://c.d/", "<body><div class=q>all</div><article><p>One article") for i in range(20)] + [(200, None, None), (201, "", "")]
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == (f"Text {i}", len(f"Text {i}")) for i in range(30))
    assert all(out[100 + i] == ("One article", 11) for i in range(20))
    assert out[200] == out[201] == ("", 0)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_in_noise_or_without_text_are_no_main_part():
    for part in ("<aside><article><h3>Card</h3></article></aside>", "<div class=related><article>Card</article></div>", "<div id=comments><main>Comment</main></div>", "<footer><div role=main>x</div></footer>", "<main></main>", "<article> <p> </p></article>"):
        assert text_of(f"<body><div>Body <b>text</b></div>{part}<div>and more</div>", set()) == "Body text and more"
    assert text_of("<body><div>Intro</div><aside><article>Card</article></aside><main>Main</main>", set()) == "Main"


def test_templates_in_articles_go_and_copied_articles_stay(spark):
    note = "<div class=box><p class=note>Written by the <b>editors</b> of this site</p></div>"
    html = lambda text: f"<body><article><h1>Title {text}</h1><p>Text {text}</p>{note}</article>"
    rows = [(i, "http://a.b/x", html(i)) for i in range(12)]
    # Copies of one article beside others, and nothing but copies.
    rows += [(100 + i, "http://a.b/y", html("copied")) for i in range(12)] + [(200 + i, "http://c.d/", html("copied")) for i in range(12)]
    out = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i} Text {i}" for i in range(12))
    assert all(out[100 + i] == "Title copied Text copied" for i in range(12))
    assert all(out[200 + i] == "Title copied Text copied Written by the editors of this site" for i in range(12))


def test_branches_combine_their_leaves(spark):
    # Each leaf of the box is too rare to be judged; the branch is not. One leaf that differs keeps its branch.
    rows = [(i, "http://a.b/", f"<body><article><p>Text {i}</p><div class=box><p class=k{i // 3}>Same {i // 3}</p></div></article>") for i in range(12)]
    rows += [(100 + i, "http://c.d/", f"<body><article><p>Text {i}</p><div class=box><p class=k{i // 3}>Other {i}</p></div></article>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert all(out[100 + i] == f"Text {i} Other {i}" for i in range(12))
    tree = {r["node"]: r for r in style_trees(pages.where("page_id < 100").selectExpr("'h' AS host", "html")).collect()}
    box, leaves = tree["body article div.box"], [tree[f"body article div.box p.k{i} #"] for i in range(4)]
    assert all((r["n"], r["importance"], r["low"]) == (3, 0.0, False) for r in leaves)
    look = 1 - (4 * 3 * math.log(3)) / (12 * math.log(12))
    assert box["n"] == 12 and abs(box["importance"] - (1 - 0.9**4) * look) < 1e-9
    assert box["low"]
    assert all(out[i] == f"Text {i}" for i in range(12))


def test_noise_words_of_containers_and_inline_elements():
    for opening in ("<div class='layout with-sidebar'>", "<div class='content comments-open'>", "<div id=no-comments>", "<nav>"):
        assert text_of(f"<body>{opening}<article><p>Body</p></article></div>", set()) == "Body"
    assert text_of("<article><p>One <span class=advert>Buy <span>now</span></span>two <a class='share'>Share</a>three</p></article>", set()) == "One two three"
    assert text_of("<article><p>a <a class=share>Share</p><p>b</p></article>", set()) == "a b"
    assert text_of("<article><p>a<img src=x>b<wbr>c</p></article>", set()) == "abc"
    assert text_of("<article>a</article><div class='site-footer'>x</div><div class=cookie-banner>y</div>", set()) == "a"


def test_any_markup_is_read():
    assert text_of("<p>a<![foo[x]]>b", set()) == "a]>b" or text_of("<p>a<![foo[x]]>b", set()) == "ab"
    assert text_of("<p>a</p><!-- unclosed <b>x</b>", set()) == "a"
    assert text_of("<p>a<![CDATA[x", set()) == "a"
    rng = random.Random(8)
    bits = ["<", ">", "!", "[", "]", "--", "<!", "<![", "<p", "</", "&", "&#", "&amp", ";", "x", "\"", "'", "=", " ", "/", "<?", "script", "CDATA[", "div", "é", "\0"]
    for _ in range(4000):
        text_of("".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), set())


def test_deep_and_long_pages_take_time_in_proportion():
    took = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        page = Page("<div class=a>x" * n + "</div>" * n)
        took.append(time.perf_counter() - began)
        assert len(page.blocks) == n
        Page("<x>" * n + "</y>" * n + "<p>" * n)
    assert took[1] < 12 * took[0] + 0.5
    assert text_of("<article>" + "<p>word</p>" * 50_000 + "</article>", set()).count("word") == 50_000


def _templated(i):
    menu = "".join(f"<li><a href=/{n}>{n}</a></li>" for n in ("Home", "World", "Sport"))
    article = "".join(f"<p>Text {i} {j} <b>bold</b></p>" for j in range(1 + i % 3))
    return (
        f"<html><head><style>p{{margin:0}}</style><script>track()</script></head><body><header><h2>Site</h2></header><nav><ul>{menu}</ul></nav>"
        f"<div class=ad><p>Buy now</p></div><div class=story><h1>Title {i}</h1>{article}</div>"
        "<div id=comments><form>Say something</form></div><footer>All rights</footer></body></html>"
    )


def test_the_tree_alone_gives_the_articles_of_templated_pages(spark):
    rows = [(i, "http://a.b/x", _templated(i)) for i in range(24)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).collect()
    for r in out:
        i = r["page_id"]
        assert r["text"] == " ".join([f"Title {i}", *(f"Text {i} {j} bold" for j in range(1 + i % 3))])
        # Style, script, heading, three items of the menu, advert, form and footer.
        assert (r["by_tree"], r["by_name"], r["blocks"]) == (9, 0, 11 + i % 3)
    # Of one page there is no tree, and names decide.
    one = extract(spark.createDataFrame(rows[:1], "page_id long, url string, html string")).first()
    assert (one["text"], one["by_tree"], one["by_name"]) == ("Title 0 Text 0 0 bold", 0, 9)


def _brute_tree(htmls):
    """{node: (n, importance, low)} of one host's pages, in plain loops: the pages, or articles, of each value."""
    holders = defaultdict(lambda: defaultdict(set))
    for number, html in enumerate(htmls):
        page = Page(html)
        article = tuple(text for _, _, text, main in page.blocks if main)
        for path, inner, text, main in page.every:
            who = article if main and page.main else number
            for value in (("look", inner), ("content", text), "page"):
                holders[path, True][value].add(who)
        for path, children, main in page.branches:
            for value in (("look", children), "page"):
                holders[path, False][value].add(article if main and page.main else number)

    def importance(values, feature, n):
        sizes = [len(who) for value, who in values.items() if value[0] == feature]
        return 1 - sum(c * math.log(c) for c in sizes) / sum(sizes) / math.log(n) if n > 1 else 1.0

    leaves, below = {}, {}
    for (path, own), values in holders.items():
        n = len(values["page"])
        if own:
            leaves[path] = (n, max(importance(values, "look", n), importance(values, "content", n)))
        else:
            below[path] = (n, importance(values, "look", n), len(values) - 1)
    inside = lambda path, at: path == at or path.startswith(at + " ")
    out = {leaf(path): (n, x, n >= LEAST_PAGES and x < LEAST_IMPORTANCE) for path, (n, x) in leaves.items()}
    branches = {}
    for path, (n, share, styles) in below.items():
        under = [v for k, v in leaves.items() if inside(k, path)]
        if under:
            mean = sum(n * x for n, x in under) / sum(n for n, _ in under)
            branches[path] = (n, (1 - GAMMA**styles) * share + GAMMA**styles * mean, max(x for _, x in under))
    for path, (n, own, top) in branches.items():
        highest = max(top, *(x for k, (_, x, _) in branches.items() if inside(k, path)), own)
        out[path] = (n, own, n >= LEAST_PAGES and highest < LEAST_IMPORTANCE)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_equal_brute_force(spark, seed):
    rng = random.Random(seed)

    def element(depth):
        tag = rng.choice(("div", "div class=x", "p", "nav", "article", "footer", "ul", "div class=ad"))
        inside = rng.choice(("same", "same", f"other {rng.randint(0, 3)}", "<b>bold</b> text"))
        return f"<{tag}>{inside}{''.join(element(depth + 1) for _ in range(rng.randint(0, 2 if depth < 3 else 0)))}</{tag.split()[0]}>"

    htmls = [f"<body>{element(0)}{element(0)}<div class=box>same<p>all</p></div></body>" for _ in range(40)]
    want = _brute_tree(htmls)
    found = {r["node"]: (r["n"], r["importance"], r["low"]) for r in style_trees(spark.createDataFrame([("h", t) for t in htmls], "host string, html string")).collect()}
    assert found.keys() == want.keys() and any(low for *_, low in want.values())
    for node, (n, importance, low) in want.items():
        assert found[node][0] == n and found[node][2] == low and abs(found[node][1] - importance) < 1e-9, node
