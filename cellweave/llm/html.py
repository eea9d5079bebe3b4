"""Main text of web pages by exact inference in a model shaped like the page's own tree.

Every block element is content or not. A node's features (tag, words of class and id, amount of
text, share of links) depend on its own state, and its state on its parent's; both tables are
counted from labelled pages. Sum-product messages pass from the leaves to the root and back, and
text stays where the marginal of its block says content.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never text of the page.
HIDDEN = set("script style template noscript iframe object svg math select button textarea head title canvas audio video".split())
#: Start tags that may stand in a head; any other, and text, ends it.
IN_HEAD = set("html head base basefont bgsound link meta title script style noscript noframes template".split())
#: Start tags that end an open svg or math, unless it holds one of the second set.
NOT_FOREIGN = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
FOREIGN_TEXT = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
TABLE_PARTS = set("table caption tbody thead tfoot tr td th".split())
OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
RAW = re.compile(r"</(script|style|textarea|title|iframe|noscript)\b[^>]*>", re.I)
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Start tags that close an open element of the second set, up to the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
NO_PARAGRAPH = BLOCKS - set("html body dd dt li td th tr tbody tfoot thead caption legend figcaption summary".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>", re.S,
)
NAMING = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Beginnings of words in class, id and role that tell what a block is for.
STEMS = (
    "advert ad ads adsense sponsor promo banner nav menu breadcrumb pager pagin foot copyright legal head masthead logo side widget aside "
    "cookie consent gdpr notice alert popup modal overlay comment repl discuss disqus respond related recommend share social follow "
    "newsletter subscri signup login search form tag meta content article post entry story body main text blog page"
).split()
WORDS_AT, LINKS_AT = (1, 5, 15, 40), (0.01, 0.25, 0.6)


class Open:
    """The open elements from the outermost inwards, with where those of each name stand."""

    def __init__(self):
        self.names, self.nodes, self.at, self.hidden = ["#root"], [0], defaultdict(list), 0

    def push(self, name: str, node: int) -> None:
        self.at[name].append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)
        self.hidden += name in HIDDEN

    def cut(self, size: int) -> None:
        """Close all but the ``size`` outermost elements."""
        while len(self.names) > size:
            name = self.names.pop()
            self.nodes.pop()
            self.at[name].pop()
            self.hidden -= name in HIDDEN

    def nearest(self, *names: str) -> int:
        """Where the innermost open element of these names stands; -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def has(self, name: str) -> bool:
        return bool(self.at.get(name))


class Page:
    """Block elements in page order with their parents, features and runs of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.naming = ["#root"], [-1], [""]
        self.runs: list[tuple[int, str]] = []
        self.words, self.linked, self.marks = [0], [0], [0]
        self._pieces: list[str] = []
        self._last: dict[str, int] = {}
        stack = Open()
        at = node = 0
        for m in self._tokens(source):
            begin, stop, name, end, attrs = m
            if stack.names[-1] == "head" and source[at:begin].strip():
                node = self._shut(stack, "head")
            if begin > at and not stack.hidden:
                self._text(node, source[at:begin], stack.has("a"))
            at = stop
            if not name:
                continue
            if not end:
                if stack.hidden and (over := self._ended(stack, name)):
                    node = self._shut(stack, over)
                    if name == over == "select":
                        continue
                if name == "button" and not self._closed(source, stop, name):
                    name = "#button"  # browsers show what an open button holds
                elif attrs.endswith("/") and (name in ("svg", "math") or stack.names[-1] in ("svg", "math")):
                    continue
                if name in NO_PARAGRAPH:
                    self._close(stack, {"p"}, {"table", "td", "button", "svg", "math", "template", *FOREIGN_TEXT})
                if name in CLOSES:
                    self._close(stack, *CLOSES[name])
                node = stack.nodes[-1]
                if name in BLOCKS:
                    self._flush(node)
                    self.tag.append(name)
                    self.parent.append(node)
                    self.naming.append(attrs)
                    for count in (self.words, self.linked, self.marks):
                        count.append(0)
                    if name in VOID:
                        continue
                    node = len(self.tag) - 1
                elif name in VOID:
                    if name == "br" and not stack.hidden:
                        self._pieces.append(" ")
                    continue
                stack.push(name, node)
            elif stack.has(name):
                if name in BLOCKS:
                    self._flush(node)
                node = self._shut(stack, name)
        if stack.names[-1] == "head" and source[at:].strip():
            node = self._shut(stack, "head")
        if not stack.hidden:
            self._text(node, source[at:], stack.has("a"))
        self._flush(node)

    @staticmethod
    def _ended(stack: Open, name: str) -> str | None:
        """The hidden element that a start tag ends without an end tag of its own, if any."""
        foreign = stack.nearest("svg", "math")
        if stack.has("template"):
            return None
        if stack.has("head") and name not in IN_HEAD and foreign < 0:
            return "head"
        if stack.has("select") and (name in ("select", "input", "textarea") or name in TABLE_PARTS and stack.has("table")):
            return "select"
        if name == "button" and stack.has("button"):
            return "button"
        return stack.names[foreign] if name in NOT_FOREIGN and foreign > stack.nearest(*FOREIGN_TEXT) else None

    @staticmethod
    def _shut(stack: Open, name: str) -> int:
        """End the innermost ``name`` and all inside it; the node that is left."""
        stack.cut(stack.nearest(name))
        return stack.nodes[-1]

    def _closed(self, source: str, at: int, name: str) -> bool:
        """Whether an end tag of ``name`` follows."""
        if name not in self._last:
            self._last[name] = max((m.start() for m in re.finditer(rf"</{name}\b", source, re.I)), default=-1)
        return self._last[name] >= at

    @staticmethod
    def _tokens(source: str):
        """(begin, stop, name, is end tag, attributes); what looks like a tag inside raw text is none."""
        # Behind the last ">" there is no whole tag, only a comment left open.
        at, last = 0, source.rfind(">") + 1
        while m := TOKEN.search(source, at, last) or OPEN_COMMENT.search(source, max(at, last)):
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                yield m.start(), len(source), "", False, ""
                return
            name = (m["name"] or "").lower()
            yield m.start(), m.end(), name, bool(m["end"]), m["attrs"] or ""
            at = m.end()
            if not m["end"] and name in ("script", "style", "textarea", "title", "iframe", "noscript"):
                # Everything up to its own end tag is passed over.
                while raw := RAW.search(source, at, last):
                    at = raw.end()
                    if raw[1].lower() == name:
                        yield at, at, name, True, ""
                        break
                else:
                    yield len(source), len(source), name, True, ""
                    return

    def _close(self, stack: Open, which: set, limit: set) -> None:
        at = stack.nearest(*which)
        if at > stack.nearest(*limit):
            self._flush(stack.nodes[-1])
            stack.cut(at)

    def _text(self, node: int, raw: str, links: int) -> None:
        text = html.unescape(raw)
        self._pieces.append(text)
        count = len(text.split())
        self.words[node] += count
        self.linked[node] += count if links else 0
        self.marks[node] += sum(map(text.count, ".,;:!?"))

    def _flush(self, node: int) -> None:
        text = " ".join("".join(self._pieces).split())
        self._pieces.clear()
        if text:
            self.runs.append((node, text))

    def features(self) -> list[tuple[str, ...]]:
        """Of each block; amounts are of its whole subtree."""
        words, linked = self.words[:], self.linked[:]
        for i in range(len(self.tag) - 1, 0, -1):
            words[self.parent[i]] += words[i]
            linked[self.parent[i]] += linked[i]
        out = []
        for i, tag in enumerate(self.tag):
            share = linked[i] / words[i] if words[i] else 0.0
            own = sum(self.words[i] >= x for x in WORDS_AT)
            out.append((
                f"tag:{tag}", f"own:{own}", f"links:{sum(share >= x for x in LINKS_AT)}",
                f"marks:{min(self.marks[i], 3)}", *(f"name:{s}" for s in stems(self.naming[i])),
            ))
        return out


@functools.lru_cache(maxsize=20_000)
def stems(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    said = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join("".join(x) for x in NAMING.findall(attrs))).lower()
    found = []
    for word in re.findall(r"[a-z]+", said):
        best = max((s for s in STEMS if (word == s if len(s) < 4 else word.startswith(s))), key=len, default=None)
        if best:
            found.append(best)
    return tuple(dict.fromkeys(found))


class Model:
    """Log probabilities of features given a node's state and of a state given the parent's."""

    def __init__(self, pages: list[tuple[Page, list[int]]]):
        nodes, seen = Counter(), defaultdict(lambda: [0, 0])
        moves = [[1.0, 1.0], [1.0, 1.0]]
        for page, states in pages:
            for i, (names, y) in enumerate(zip(page.features(), states)):
                nodes[y] += 1
                for name in names:
                    seen[name][y] += 1
                if page.parent[i] >= 0:
                    moves[states[page.parent[i]]][y] += 1
        self.move = [[math.log(m / sum(row)) for m in row] for row in moves]
        # A feature's weight is what it says for content against not content.
        self.weight = {n: math.log((c[1] + 0.1) / (nodes[1] + 0.2)) - math.log((c[0] + 0.1) / (nodes[0] + 0.2)) for n, c in seen.items()}

    def marginals(self, page: Page) -> list[float]:
        """Probability that each block is content, by messages up the tree and down again."""
        n = len(page.tag)
        own = [(0.0, sum(self.weight.get(f, 0.0) for f in names)) for names in page.features()]
        own[0] = (0.0, -20.0)  # the page as a whole is not the article
        belief = [list(x) for x in own]
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            message = self._sum(self.move[0], belief[i]), self._sum(self.move[1], belief[i])
            up[i] = message
            above = belief[page.parent[i]]
            above[0] += message[0]
            above[1] += message[1]
        for i in range(1, n):
            above, message = belief[page.parent[i]], up[i]
            rest = above[0] - message[0], above[1] - message[1]
            belief[i][0] += self._sum((self.move[0][0], self.move[1][0]), rest)
            belief[i][1] += self._sum((self.move[0][1], self.move[1][1]), rest)
            top = max(belief[i])
            belief[i] = [belief[i][0] - top, belief[i][1] - top]
        return [1 / (1 + math.exp(min(b[0] - b[1], 700.0))) for b in belief]

    @staticmethod
    def _sum(a, b) -> float:
        x, y = a[0] + b[0], a[1] + b[1]
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))


#: Labelled pages: what surrounds an article (in front, inside, behind) and how articles are marked.
AROUND = [
    '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">World news</a></li></ul></nav>',
    '<header class="site-header"><div class="logo"><a href="/">The Site</a></div></header>',
    '<div class="menu" role="navigation"><a href="/a">One</a> <a href="/b">Two</a></div>',
    '<div id="navbar"><ul class="nav"><li><a href="/x">Start</a></li></ul></div>',
    '<div class="breadcrumb"><a href="/">Home</a> / <a href="/c">Section</a></div>',
    '<div class="ad">Buy one of these today, it costs less than before.</div>',
    '<div class="advert banner"><p>Only this week: all shoes at half price, come and see.</p></div>',
    '<div class="sponsored promo"><p>From our partners: a new way to save on energy bills, read more.</p></div>',
    '<div class="cookie-notice" role="alert"><p>We use cookies to make this page better. Do you accept them?</p><button>Yes</button></div>',
    '<div id="gdpr-consent" class="popup modal overlay"><p>Your privacy matters to us, please choose your settings.</p></div>',
    '<div class="notice"><p>This page is shown in another language, choose yours above.</p></div>',
    '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">First headline of the day</a></li></ul></aside>',
    '<div class="side widget"><h4>Weather</h4><p>Sunny with some clouds, twenty degrees.</p></div>',
    '<aside><p>About the author: writes on many things and lives by the sea.</p></aside>',
    '<section class="related recommended"><h2>Related</h2><p><a href="/r">Another story you may like</a></p></section>',
    '<section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this, it was better before.</p></div></section>',
    '<div class="comment-list"><ol><li class="comment reply"><p>Great text, thank you so much for writing it down.</p></li></ol></div>',
    '<div id="disqus_thread" class="discussion respond"><p>What a story, tell me more about it, please.</p></div>',
    '<form action="/s" class="search-form"><label>Search</label><input name="q"><p>Type a word and press enter.</p></form>',
    '<form class="newsletter subscribe signup"><p>Get our letter every morning, free of charge.</p><input name="mail"></form>',
    '<form id="login"><p>Sign in with your name and password to go on.</p></form>',
    '<div class="share social follow"><ul><li><a href="/f">Share</a></li><li><a href="/t">Follow</a></li></ul></div>',
    '<div class="pagination pager"><a href="/2">Next page</a></div>',
    '<footer class="footer"><p>&copy; The Site. All rights reserved. Nothing may be copied.</p></footer>',
    '<footer>&copy; site &middot; Made with care by all of us here.</footer>',
    '<div class="legal copyright"><p>Terms of use and privacy rules apply to all visitors.</p></div>',
    '<menu><li><a href="/m">Menu entry</a></li></menu>',
]
ARTICLES = [
    "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="article-body">{}</div>', "<main><article>{}</article></main>",
    '<section class="post entry-content">{}</section>', '<div class="story main-text">{}</div>', '<article class="blog post">{}</article>', "<div>{}</div>",
]
INSIDE = [
    "<h1>A headline for the day</h1>", "<p>He came home late, and nobody asked why.</p><p>It was cold, and it rained again that night.</p>", "<p>{}</p>",
    "<p>They said yes, and that was that, in the end.</p><p>Nobody knew who had paid for it all, or when.</p><p>So it stayed as it was.</p>",
    "<p>On the way home they passed the old bridge and the house by the water where the smith had lived for most of his life</p><p>{}</p>",
    "<p>Four men and two boys took the boat out that evening to look for the missing nets near the rocks, but they found nothing.</p>", "<p>{}</p><p>{}</p>", "<h2>Part two of it</h2><p>{}</p>", "<p>Short line.</p>", "<p>One.</p>",
    "<ul><li>First of the points, told in some words.</li><li>Second of them.</li></ul>", "<blockquote><p>{}</p></blockquote>",
    "<p>{} <a href='/w'>with a link</a> and more behind it.</p>", "<pre>code = words(text)</pre>", "<div><p>{}</p></div>",
    "<table><tr><td>Name</td><td>Some value</td></tr></table>", "<figure><figcaption>A view of the town.</figcaption></figure>", "<section><h3>More</h3><p>{}</p></section>",
]
PROSE = [
    "It rained for days, and nobody in the village knew when the road would be open again; the river kept rising.",
    "Later that year the council voted, seven to five, to keep the old mill, which has stood empty since the war ended.",
    "Most of them agreed. Some did not.", "There is more to say about the way it was built, how long it took, what it cost and who paid for it in the end.",
]


@functools.cache
def labelled_pages() -> list[tuple[Page, list[int]]]:
    """Pages put together from the parts above in turn, with the state of each block."""
    out = []
    for turn in range(8 * len(AROUND)):
        prose = (PROSE[i % len(PROSE)] for i in range(turn, 10_000))
        parts = [INSIDE[0]] + [INSIDE[(turn * 5 + i * (1 + turn % 3)) % len(INSIDE)] for i in range(2 + turn % 12)]
        # Paragraphs of one to nine sentences.
        sizes = (1 + (turn * 3 + i * 7) % 9 for i in range(10_000))
        inner = "".join(re.sub(r"\{}", lambda _: " ".join(next(prose) for _ in range(next(sizes))), p) for p in parts)
        guest = f"<!--off-->{AROUND[(turn * 7 + 3) % len(AROUND)]}<!--on-->" if turn % 3 == 0 else ""
        article = f"<!--on-->{ARTICLES[turn % len(ARTICLES)].format(inner + guest)}<!--off-->"

        def around(i: int) -> str:
            # Every other part also holds prose of its own, so that wording alone tells little.
            part, end = AROUND[i % len(AROUND)].rpartition("</")[::2]
            more = (next(prose), f"<p>{next(prose)}</p>", f"{next(prose)} {next(prose)}", "", "")[(turn + i) % 5]
            return f"{part}{more}</{end}"

        before = "".join(around(turn + i * 4) for i in range(1 + turn % 3))
        behind = "".join(around(turn * 3 + i * 5 + 2) for i in range(1 + turn % 4))
        wrap = ('<div class="page">{}</div>', "{}", '<div id="main">{}</div>')[turn % 3]
        source = "<html><head><title>t</title></head><body>" + wrap.format(before + article + behind) + "</body></html>"
        # The state of a block is that of the last mark in front of its start tag.
        page, states, on = Page(source), [0], 0
        for m in TOKEN.finditer(source):
            if m[0] in ("<!--on-->", "<!--off-->"):
                on = int(m[0] == "<!--on-->")
            elif not m["end"] and (m["name"] or "") in BLOCKS:
                states.append(on)
        out.append((page, states))
    return out


@functools.cache
def default_model() -> Model:
    return Model(labelled_pages())


def main_text(source: str, model: Model) -> str:
    page = Page(source)
    likely = model.marginals(page)
    return "\n\n".join(text for node, text in page.runs if likely[node] > 0.5)


def _extract(source: pa.Array) -> pa.Array:
    model = default_model()
    return pa.array([main_text(s.as_py() or "", model) for s in source], pa.string())


def extracted(source: Column) -> Column:
    return arrow_udf(_extract, "string")(source)


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of whole pages as column ``text`` (replaced if it is there).

    Blocks are in page order, joined by an empty line; character references are decoded and white
    space inside a block is one space. Null and empty pages and pages without an article have an
    empty text; broken and unclosed markup is read as browsers close it; repeated rows stay.
    """
    return small_batches(pages).withColumn(text, extracted(F.col(source)))
