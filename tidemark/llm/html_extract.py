"""Main-text extraction by a tree-structured graphical model over DOM nodes.

A page's block elements form a tree; each is content or not. A node's potential comes from
its features (tag, words of its class, id and role, link share, length, punctuation), an
edge's from the child's tag and both ends' states. Sum-product messages go up from the
leaves and down from the root, so every node gets its exact marginal; text in nodes with a
marginal of at least 0.5 is the page's main text (for pages where none has that, see chosen()). All pages of a batch are worked level by
level, so a step is a few array operations.

Potentials are smoothed counts from labelled pages that label_pages() makes by rule
(`LABELLED` of them, fixed seed): articles in the usual containers amid menus, headers,
footers, sidebars, notices, adverts, forms and reader comments.

Null and empty html give an empty text; markup that doesn't parse is read as browsers do:
unclosed elements end with their parent (a head at the first thing that can't stand in it),
stray end tags are ignored, a tag that never ends hides what follows. Pages of any length
and depth are read in one pass, in time linear in their length. Repeated rows are extracted
each for itself; an empty table gives no rows; further columns are left out whatever their
names.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import of, spread

LABELLED = 400
FLOOR = 0.03  # menus, notices and the like have marginals under 0.01
# Fixed values of HTML: elements by their part in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math iframe object select option textarea button head title canvas audio video map dialog datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
IN_HEAD = frozenset("html head base link meta title noscript style script template".split())
#: Start tags that end an svg or math, but for those inside the elements that hold HTML there.
LEAVES_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
TAGS = ("p", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "li", "heading", "quote", "table", "cell", "figure", "body", "other")
_TAG = {t: i for i, t in enumerate(TAGS)} | dict.fromkeys(HEADINGS, 12) | {"ol": 10, "dl": 10, "menu": 10, "dt": 11, "dd": 11, "blockquote": 13, "pre": 13, "q": 13, "td": 15, "th": 15, "tr": 14, "tbody": 14, "thead": 14, "tfoot": 14, "figcaption": 16, "html": 17, "hgroup": 3, "fieldset": 9}
#: Words of class, id and role that speak for a part of a page.
PARTS = (
    ("content", "article main content post story entry text body prose richtext markdown"),
    ("menu", "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs toolbar skip"),
    ("page_edge", "header masthead banner footer foot copyright legal colophon contentinfo topbar bottom"),
    ("side", "sidebar side aside related recommended recommendations popular trending widget rail complementary teaser more tags"),
    ("notice", "notice cookie cookies consent gdpr alert popup modal overlay paywall subscribe newsletter disclaimer warning message"),
    ("advert", "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner-ad adsense outbrain taboola"),
    ("form", "form search login signin signup register contact"),
    ("comments", "comment comments disqus reply replies discussion respond feedback review reviews"),
    ("share", "share sharing social follow author-bio byline meta metadata"),
)
_PART = {w: i + 1 for i, (_, words) in reversed(list(enumerate(PARTS))) for w in words.split()}
HIDDEN = len(PARTS) + 1
_word = re.compile(r"[a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_space = re.compile(r"\s+")
_attribute = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A comment, a tag (quotes count after "=" only), another declaration, or the start of a tag that never ends.
#: Nothing is tried twice: what stands in possessive groups isn't given back.
_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|(?!["'])))*+)>|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])""", re.S)
_end_of = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
FEATURES = (len(TAGS), len(TAGS) * (HIDDEN + 1), 5, 5, 3)  # sizes: tag, part of the tag, link share, length, end of text


def _part(attributes: str) -> int:
    """The part that an element's attributes speak for; 0 if none does."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    found = []
    for name, value in _attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return HIDDEN
        if name in ("class", "id", "role", "itemprop", "data-component"):
            found += [_PART[w] for w in _word.findall(_camel.sub(" ", value).lower()) if w in _PART]
    against = [x for x in found if x != 1]
    return against[0] if against else (1 if found else 0)


class _Open:
    """The open elements, with the places of each name, so that no step looks through them all."""

    def __init__(self):
        self.names, self.nodes = ["#"], [0]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  # places of elements that aren't inline

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def close(self, i: int) -> None:
        """Ends the element at place i and all within it."""
        while len(self.names) > i:
            name = self.names.pop()
            self.nodes.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names; 0 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def first_from(self, name: str, place: int) -> int:
        """Place of the outermost open element of this name from a place on; 0 if none is."""
        at = self.places.get(name, [])
        i = bisect_left(at, place)
        return at[i] if i < len(at) else 0


class Page:
    """Block elements of one page, in order: parent, tag, part, and text runs of (node, text, is link)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.part, self.runs = [-1], [_TAG["body"]], [0], []
        open_ = _Open()
        names, nodes = open_.names, open_.nodes
        silent = 0  # place of the outermost silent element

        def close(i: int) -> None:
            nonlocal silent
            open_.close(i)
            silent = silent if silent < i else 0

        def say(text: str) -> None:
            if names[-1] == "head" and text.strip():
                close(len(names) - 1)
            if text and not silent:
                self.runs.append((nodes[-1], text, bool(open_.places.get("a"))))

        at = 0
        while m := _token.search(source, at):
            say(source[at : m.start()])
            at = m.end()
            if m[0] == "<":  # a tag that never ends: nothing follows
                at = len(source)
                break
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                i = open_.last(name)
                if i and not (name in INLINE and open_.blocks[-1] > i):  # an inline end tag doesn't end the blocks opened since
                    close(i)
                continue
            if silent:
                foreign = open_.last("svg", "math")
                foreign = foreign if foreign >= silent else 0
                if names[silent] == "head" and (name == "body" or (len(names) == silent + 1 and name not in IN_HEAD)):
                    close(silent)
                elif foreign and name in LEAVES_FOREIGN and open_.last(*HTML_INSIDE) < foreign:
                    close(foreign)
                elif foreign and m[3].endswith("/"):
                    continue
                elif name in ("button", "select") and (i := open_.first_from(name, silent)):
                    close(i)
            if (name == "br" or name == "hr") and not silent:
                self.runs.append((nodes[-1], " ", bool(open_.places.get("a"))))
            if name in VOID:
                continue
            if name in SILENT:
                if m[3].endswith("/") and name not in RAW:
                    continue
                if name in RAW:  # up to its own end tag, whatever stands between
                    end = _end_of[name].search(source, at)
                    at = end.end() if end else len(source)
                    continue
                silent = silent or len(names)
                open_.push(name, nodes[-1])
                continue
            rows = name in ("tr", "tbody", "tfoot")  # these end cells and rows alike
            for targets, fence in ((SIBLINGS.get(name), FENCES.get(name, ())), (("p",), ("table", "td", "th", "button")) if name in CLOSES_P else (None, ())):
                while targets and (i := open_.last(*targets)) > open_.last(*fence):
                    close(i)
                    if not rows:
                        break
            if name in INLINE or silent:
                open_.push(name, nodes[-1])
                continue
            self.parent.append(nodes[-1])
            self.tag.append(_TAG.get(name, len(TAGS) - 1))
            self.part.append(_part(m[3]))
            open_.push(name, len(self.parent) - 1)
        say(source[at:])
        self.runs = [(n, html.unescape(t), a) for n, t, a in self.runs]

    def node_features(self) -> np.ndarray:
        n = len(self.parent)
        size, linked, ends = [0] * n, [0] * n, [0] * n
        for node, text, link in self.runs:
            text = text.strip()
            if text:
                size[node] += len(text)
                linked[node] += len(text) * link
                ends[node] = 1 + (text[-1] in ".!?…:;\"'»”’)。！？")
        size, linked = np.array(size), np.array(linked)
        share = np.where(size == 0, 0, 1 + np.digitize(linked / np.maximum(size, 1), (0.05, 0.34, 0.8)))
        named = np.array(self.tag) * (HIDDEN + 1) + self.part
        return np.stack([self.tag, named, share, np.digitize(size, (1, 25, 80, 250)), ends], axis=1)

    def text(self, content: np.ndarray) -> str:
        """Text of content nodes, in page order; blocks are joined by one space."""
        out, last = [], -1
        for node, text, _ in self.runs:
            if content[node]:
                out.append(text if node == last else " " + text)
            last = node
        return _space.sub(" ", "".join(out)).strip()


class Model:
    """Log potentials: nodes[i][value, state], edges[child tag][parent state, child state], root[state]."""

    def __init__(self, nodes, edges, root):
        self.nodes, self.edges, self.root = nodes, edges, root

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content of each node of each page."""
        first = np.cumsum([0, *(len(p.parent) for p in pages)])
        parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + o) for p, o in zip(pages, first)])
        x = np.concatenate([p.node_features() for p in pages])
        depth = np.zeros(len(parent), np.int64)
        for i in range(len(parent)):  # parents come before children
            if parent[i] >= 0:
                depth[i] = depth[parent[i]] + 1
        own = sum(table[x[:, i]] for i, table in enumerate(self.nodes))
        own = own + np.where(parent < 0, 1, 0)[:, None] * self.root
        edge = self.edges[x[:, 0]]
        levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        up, message = own.copy(), np.zeros_like(own)
        for at in reversed(levels[1:]):  # upward: what each child tells its parent
            message[at] = np.logaddexp.reduce(edge[at] + up[at][:, None, :], axis=2)
            np.add.at(up, parent[at], message[at])
        belief = up.copy()
        for at in levels[1:]:  # downward: the parent's belief without this child's message
            rest = belief[parent[at]] - message[at]
            belief[at] = up[at] + np.logaddexp.reduce(edge[at] + rest[:, :, None], axis=1)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))
        return [p[a:b] for a, b in zip(first, first[1:])]


def label_pages(n: int = LABELLED, seed: int = 11):
    """(html, the root's label) of n pages made by rule. Each block element but html has
    data-y="1" if it is content, else "0"."""
    r, ends = random.Random(seed), ("", ".", ".", "***", ".###", ".&&&")
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(300)]

    def say(a, b, end="."):
        return " ".join(r.choice(words) for _ in range(r.randint(a, b))).capitalize() + end

    def el(tag, y, body, attributes=""):
        return f'<{tag} data-y="{y}"{" " + attributes if attributes else ""}>{body}</{tag}>'

    def name(*names):  # some sites have names of their own
        return r.choice(names) if r.random() < 0.85 else f"{r.choice(words)}-{r.choice(words)}"

    def named(*names):
        return r.choice(["class", "class", "id"]) + f'="{name(*names)}"' if r.random() < 0.8 else ""

    def links(k, y=0):
        return el(r.choice(["ul", "ul", "div"]), y, "".join(el("li", y, f'<a href="/x">{say(1, 3, "")}</a>') for _ in range(k)))

    def paragraph(y=1):
        kind, body = r.random(), say(1, 60)
        if kind < 0.15:
            body = f"<b>{say(1, 8)}</b> {body}"
        elif kind < 0.3:
            body += f' <a href="/y">{say(1, 3, "")}</a> {say(2, 20)}'
        elif kind < 0.36:
            body = say(1, 3, r.choice(ends))
        elif kind < 0.4:
            body = "".join(r.choice("#$%&*") + r.choice(words) + " " for _ in range(30))
        return el("p", y, body)

    def article():
        if r.random() < 0.15:  # hardly anything, or marks only
            body = say(1, 3, r.choice(ends))
            return el("h1", 1, body) + el("p", 1, r.choice([body, say(1, 4, r.choice(ends))]))
        parts = [el(r.choice(["h1", "h1", "h2"]), 1, say(2, 12, r.choice(["", "."])))]
        for _ in range(r.randint(1, 9)):
            k = r.random()
            if k < 0.78:
                parts.append(paragraph())
            elif k < 0.84:
                parts.append(el(r.choice(["h2", "h3"]), 1, say(1, 6, "")))
            elif k < 0.9:
                parts.append(el(r.choice(["ul", "ol"]), 1, "".join(el("li", 1, say(3, 20, r.choice(["", "."]))) for _ in range(r.randint(2, 5)))))
            elif k < 0.94:
                parts.append(el("blockquote", 1, el("p", 1, say(5, 30))))
            elif k < 0.97:
                parts.append(el("table", 1, "".join(el("tr", 1, "".join(el("td", 1, say(1, 3, "")) for _ in range(3))) for _ in range(3))))
            else:
                parts.append(el("section", 1, paragraph() + paragraph()))
            if r.random() < 0.06:
                parts.append(r.choice(extras)())
        return "".join(parts)

    def menu():
        return el(*r.choice([("nav", 0, links(r.randint(3, 8))), ("div", 0, links(r.randint(3, 8)), named("menu", "main-nav", "navbar", "breadcrumbs"))]))

    def head():
        return el(*r.choice([("header", 0, el("div", 0, say(1, 4, "")) + menu()), ("div", 0, el("p", 0, say(1, 5, "")), named("header", "masthead", "topbar"))]))

    def foot():
        return el(*r.choice([("footer", 0, "© 2024 " + say(2, 12)), ("footer", 0, el("p", 0, say(3, 15)) + links(3)), ("div", 0, el("p", 0, "© " + say(2, 14)), named("footer", "site-footer", "copyright"))]))

    def side():
        tag = r.choice(["aside", "div"])
        return el(tag, 0, el("h3", 0, say(1, 3, "")) + r.choice([links(4), paragraph(0) + paragraph(0)]), named("sidebar", "related", "widget") if tag == "aside" else f'class="{name("sidebar", "related-posts", "widget", "recommended")}"')

    def boxed(*names, tag="div"):
        return lambda: el(tag, 0, r.choice([say(3, 25), el("p", 0, say(3, 30)), el("p", 0, say(3, 12)) + f'<a href="/z">{say(1, 3, "")}</a>']), f'{r.choice(["class", "id"])}="{name(*names)}"')

    notice = boxed("cookie-notice", "consent", "alert", "newsletter", "notice", "popup", "disclaimer", "subscribe-box")
    advert = boxed("ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot")
    share = boxed("share", "social", "sharing-buttons", "follow")

    def form():
        return el("form", 0, r.choice([say(1, 4, "") + "<input name=q>", el("p", 0, say(2, 9)) + "<label>" + say(1, 2, "") + "</label><input>"]), r.choice(["", 'class="search"', 'id="login"']))

    def comments():
        one = lambda: el(r.choice(["div", "li", "article"]), 0, el("p", 0, say(3, 40)), 'class="comment"')
        return el(r.choice(["section", "div", "ol"]), 0, el("h3", 0, say(1, 3, "")) + "".join(one() for _ in range(r.randint(1, 4))), f'{r.choice(["class", "id"])}="{name("comments", "reader-comments", "discussion", "comment-list", "replies")}"')

    extras = [advert, share, notice, side, form, comments]
    for _ in range(n):
        kind = r.random()
        if kind < 0.5:
            main = el("article", 1, article(), r.choice(["", "", 'class="post"', 'id="story"']))
        elif kind < 0.65:
            main = el("main", 1, r.choice([article(), el("article", 1, article()), el("div", 1, article())]), r.choice(["", 'role="main"', 'id="content"']))
        elif kind < 0.9:
            main = el("div", 1, r.choice([article(), el("div", 1, article())]), f'{r.choice(["class", "id"])}="{name("content", "article-body", "post", "entry-content", "main", "story", "text")}"')
        elif kind < 0.95:
            main = el("section", 1, article(), named("content", "article"))
        else:
            main = article()  # straight in the body
        around = [f() for f in (head, menu) if r.random() < 0.7] + [f() for f in (advert, notice, form) if r.random() < 0.3]
        after = [f() for f in (side, comments, share, advert, notice) if r.random() < 0.35] + [foot()] * (r.random() < 0.9)
        body = "".join(around) + main + "".join(after)
        bare = int(kind >= 0.95)  # then the body itself is content
        if not bare and r.random() < 0.3:
            body = el("div", 0, body, named("page", "wrapper", "container"))
        whole = f"<html><head><title>{say(2, 6)}</title></head>{el('body', bare, body)}</html>"
        yield (whole, 0) if r.random() < 0.85 else (body, bare)


@cache
def trained(n: int = LABELLED) -> Model:
    """The model of smoothed counts over the labelled pages."""
    nodes = [np.full((k, 2), 0.5) for k in FEATURES]
    edges, root = np.full((len(TAGS), 2, 2), 0.5), np.array([1.0, 0.5])
    label = re.compile(r"""<([a-z0-9]+) data-y="([01])\"""")
    for source, base in label_pages(n):
        marks = [int(y) for tag, y in label.findall(source) if tag not in INLINE]
        page = Page(source)
        y = np.array([base] * (len(page.parent) - len(marks)) + marks)
        x = page.node_features()
        for i, table in enumerate(nodes):
            np.add.at(table, (x[:, i], y), 1)
        up = np.array(page.parent)
        at = np.flatnonzero(up >= 0)
        np.add.at(edges, (x[at, 0], y[up[at]], y[at]), 1)
        root[base] += 1
    share = nodes[0].sum(axis=0)
    tables = []
    for i, table in enumerate(nodes):
        seen = np.log(table / share)
        if i == 0:  # the tag speaks through its edge
            seen = np.zeros_like(seen)
        elif i == 1:  # words of class, id and role given the tag, drawn towards those of all tags
            count = table.reshape(len(TAGS), HIDDEN + 1, 2) - 0.5
            overall = (count.sum(axis=0) + 0.5) / (count.sum(axis=0) + 0.5).sum(axis=0)
            seen = np.log((count + 3 * overall) / (count.sum(axis=1, keepdims=True) + 3)).reshape(-1, 2)
        tables.append(seen)
    return Model(tables, np.log(edges / edges.sum(axis=2, keepdims=True)), np.log(root / root.sum()))


def chosen(page: Page, content: np.ndarray) -> np.ndarray:
    """The nodes whose text is taken: those of a marginal of 0.5 or more.

    Where none of them has text, as with a single paragraph under a name that nothing is known of, the best
    one says what content looks like on this page, and those at least half as likely are taken with it.
    What is below FLOOR is no article: then there is none.
    """
    said = np.zeros(len(content), bool)
    said[[node for node, text, _ in page.runs if text.strip()]] = True
    best = content[said].max(initial=0)
    return content >= (0.5 if best >= 0.5 or best < FLOOR else best / 2)


def extract(source: str) -> str:
    page = Page(source)
    return page.text(chosen(page, trained().marginals([page])[0]))


def _extracted(batches):
    model = trained()
    for b in batches:
        out = []
        for lo in range(0, b.num_rows, 64):
            pages = [Page(x.as_py() or "") for x in b.column(2).slice(lo, 64)]
            out += [p.text(chosen(p, m)) for p, m in zip(pages, model.marginals(pages))] if pages else []
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of rows (page_id, url, html)."""
    return spread(of(pages, page_id="long", url="string", html="string")).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
