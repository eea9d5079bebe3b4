import itertools
import math
import re
import time
from html import unescape

from cellweave.llm import html


def test_pages_of_the_table(spark, small):
    """Against a plain cut of the article in these well-known pages."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<(br|/?b)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_unseen_layouts():
    para = "There was once a town by the river, and in it lived a smith who made bells; nobody knew why. He said little."
    page = f"""<!doctype html><body><header id=top><a href=/>Site</a></header><div class="mainNav"><ul><li><a href=1>a b<li><a href=2>c</ul></div>
    <div id="cookie-banner"><p>We use cookies, please accept them.</p></div>
    <div class="post-content"><h1>Bells &amp; more</h1><p>{para}<p>{para} <a href=x>More</a> of\n it.<br>End &lt;now&gt;&nbsp;here
    <div class="advert">Buy a bell, it is cheap.</div><ul><li>First of all, bells.<li>Then more.</ul><script>if (a < b) "<p>no</p>"</script></div>
    <section class="comments"><h3>Comments</h3><p>Nice text, I liked the part with the bells very much.</p></section>
    <form><p>Write to us, please, we like letters.</p></form><aside class="sidebar"><p>Other news of the day, in short.</p></aside>
    <footer><p>All rights reserved, 2020. Do not copy anything from this page without asking.</p></footer>"""
    want = f"Bells & more\n\n{para}\n\n{para} More of it. End <now> here\n\nFirst of all, bells.\n\nThen more."
    assert html.main_text(page, html.default_model()) == want


def test_marginals_are_those_of_all_states():
    """Messages against the sum over every assignment of a small page."""
    model = html.default_model()
    page = html.Page('<body><div class="x"><p>One two three four five.</p><nav><a href=1>a</a></nav></div><article><p>Six.</p></article>')
    n = len(page.tag)
    own = [sum(model.weight.get(f, 0.0) for f in names) for names in page.features()]
    own[0] = -20.0
    total, on = 0.0, [0.0] * n
    for state in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(own[i] for i in range(n) if state[i]) + sum(model.move[state[page.parent[i]]][state[i]] for i in range(1, n)))
        total += p
        for i in range(n):
            on[i] += p * state[i]
    got = model.marginals(page)
    assert all(abs(got[i] - on[i] / total) < 1e-9 for i in range(1, n))


def test_labelled_pages_are_told_apart():
    model = html.default_model()
    right = total = 0
    for page, states in html.labelled_pages():
        got = model.marginals(page)
        right += sum((g > 0.5) == bool(y) for g, y in zip(got, states))
        total += len(states)
    assert right / total > 0.99


def test_broken_markup_and_odd_rows(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, None), (2, ""), (3, "<"), (4, "plain text, no tags at all"), (5, "<p title='a>b'>x</p"), (6, "<!-- never closed <p>a</p>"), (7, deep), (7, deep), (8, "<script>never closed <p>x"), (9, "a &amp &#65 &nope; < b")]
    df = spark.createDataFrame(rows, "page_id int, html string").selectExpr("*", "html AS text")
    got = html.extract(df).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html.extract(df.limit(0)).count() == 0


def test_one_long_page():
    page = "<article>" + "<p>Some words of text, again and again.</p>" * 30_000 + "</article>"
    assert html.main_text(page, html.default_model()).count("\n\n") == 29_999


def test_open_hidden_elements_end_as_in_browsers():
    article = "<article><h1>Bells again</h1><p>It rained for days, and nobody knew when it would end.</p></article>"
    want = "Bells again\n\nIt rained for days, and nobody knew when it would end."
    model = html.default_model()
    for before in (
        "<html><head><title>t</title><body>", "<head><meta charset=x><link href=y>", "<head><style>a</style> <div>", "<head>Loose text",
        "<body><button>Go", "<body><button>Go<button>On</button>", "<body><svg><path d='M0'><div>", "<body><svg viewBox='0'/>", "<math><mi>x</mi><div>",
        "<table><tr><td><select><option>a<tr><td>b</table>", "<div><select><option>a<select></div>", "<div><select><option>a<input></div>",
    ):
        got = html.main_text(before + article, model)
        assert want in got, (before, got)
    for inside in ("<button>no</button>", "<select><option>no</select>", "<svg><desc><p>no</p></desc><text>no</text></svg>", "<template><body>no</body></template>"):
        assert html.main_text(article.replace("</p>", inside + "</p>"), model) == want, inside


def test_broken_pages_take_linear_time():
    model = html.default_model()
    for page in (
        "<div>" * 200_000, "<a " * 200_000, "<p><b>" * 100_000, "<script>" + "</script " * 100_000, "<svg><g>" * 60_000 + "<p>x", "<button>" * 100_000,
        "<li>" * 200_000, "<table><tr><td>" * 50_000, "<p><button><div>" * 50_000, "<!" * 200_000, "<a '" * 100_000,
    ):
        start = time.process_time()
        html.main_text(page, model)
        assert time.process_time() - start < 5, page[:20]


def test_comments_left_open_reach_to_the_end():
    assert html.Page("<p>a</p><!-- b <p>c</p> d").runs == [(1, "a")]
    assert html.Page("<p>a</p><!-- b > c").runs == [(1, "a")]
