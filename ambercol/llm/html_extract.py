"""HTML extraction with a tree-structured graphical model over the DOM.

Each node has a hidden label, content or boilerplate. A node's label depends on its parent's through a potential that its kind of
element selects (parent-child potential), and its observed features depend on its label (node potentials). Sum-product messages
pass from the leaves to the root and back, which gives each node's exact content marginal; text whose marginal is at least a half
is kept. All potentials are smoothed relative frequencies over labelled pages (``labelled_pages`` makes such pages; pages of
your own may stand in for them).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, texts_of

# Element names of the HTML standard, by how they behave here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas textarea select datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table html body div article section main aside nav header footer form blockquote td th".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|/?\Z)", re.DOTALL)
#: A name and a value, quoted or bare, so that what stands in quotes or within another name is no attribute of its own.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_READ = frozenset("class id role data-label hidden aria-hidden".split())
_NAME = re.compile(r"[a-z]+")

# Words in class and id names, and what they tell of an element.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap tabs",
    "frame": "header masthead footer foot copyright legal topbar bottom site banner logo colophon",
    "side": "sidebar aside side rail widget related recommended popular trending tags share social newsletter subscribe promo teaser author bio",
    "advert": "ad ads advert advertisement adsense sponsor sponsored sponsors dfp",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert toast banner privacy paywall",
    "talk": "comment comments reply replies discussion disqus respond thread responses",
    "form": "form search login signup register input captcha",
    "main": "article content main post entry story body text prose page",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
# Groups of elements that share potentials.
GROUPS = {
    "article": "article main", "nav": "nav menu", "head": "header hgroup", "foot": "footer", "aside": "aside", "form": "form button fieldset label input dialog",
    "heading": "h1 h2 h3 h4 h5 h6", "para": "p pre blockquote figcaption dt dd", "list": "ul ol dl li", "table": "table thead tbody tfoot tr td th caption",
    "box": "div section center body html figure details summary address", "link": "a",
}
_GROUP = {t: g for g, tags in GROUPS.items() for t in tags.split()}


class Node:
    __slots__ = ("tag", "parent", "hint", "label", "text", "unseen", "chars", "linked", "words", "stops", "features")

    def __init__(self, tag: str, parent: int, hint: str = "none", label: str | None = None, text: str = "", unseen: bool = False):
        self.tag, self.parent, self.hint, self.label, self.text, self.unseen = tag, parent, hint, label, text, unseen or tag in HIDDEN
        self.chars = self.linked = self.words = self.stops = 0
        self.features: tuple[str, ...] = ()


def _hint(attributes: str) -> tuple[str, str | None, bool]:
    hints, label, hidden = [], None, False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name not in _READ:
            continue
        value = (m[2] or "").strip("\"'").lower()
        if name == "data-label":
            label = value
        elif name in ("class", "id", "role"):
            hints += [_HINT[w] for w in _NAME.findall(value) if w in _HINT]
        else:
            hidden |= name == "hidden" or value == "true"
    worst = [h for h in hints if h != "main"]
    return (worst or hints or ["none"])[0], label, hidden


def parse(page: str) -> list[Node]:
    """The DOM of a page, parents before children, text as nodes of tag '#'. Bad nesting and cut-off pages are borne.

    Time is linear in the page: each tag's open elements are kept with their depths, so what an end tag closes is found at any depth.
    """
    nodes = [Node("html", -1)]
    stack = [0]
    depths: dict[str, list[int]] = {}
    at, end = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a and (plain := html.unescape(page[a:b])).strip():
            nodes.append(Node("#", stack[-1], text=plain))
        elif b > a and len(nodes) > 1:
            nodes.append(Node("#", stack[-1], text=" "))

    def close(tags: set[str] | frozenset[str], stops: frozenset[str] | set[str] = SCOPES) -> None:
        innermost = lambda names: max((depths[x][-1] for x in names if depths.get(x)), default=0)
        k = innermost(tags)
        if k and k >= innermost(stops):
            for gone in stack[k:]:
                depths[nodes[gone].tag].pop()
            del stack[k:]

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close({tag}, frozenset() if tag not in INLINE and tag not in CLOSED_BY and tag != "p" else SCOPES - {tag})
            continue
        if tag in HIDDEN:
            if tag in RAW:
                over = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = over.end() if over else end
                continue
            if m[3].endswith("/"):
                continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            close({"p"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], frozenset({"ul", "ol", "dl", "table"}))
        hint, label, hidden = _hint(m[3]) if m[3] else ("none", None, False)
        nodes.append(Node(tag, stack[-1], hint, label, unseen=hidden))
        if tag not in VOID and not m[3].endswith("/"):
            depths.setdefault(nodes[-1].tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
    text(at, end)
    return nodes


def observe(nodes: list[Node]) -> None:
    """Features of each node, from its own element and its subtree: links' share of the text, length, sentence marks."""
    inside = [False] * len(nodes)
    for k, n in enumerate(nodes):
        inside[k] = n.tag == "a" or n.parent >= 0 and inside[n.parent]
        if n.tag == "#":
            n.chars = len(n.text)
            n.linked = n.chars if inside[k] else 0
            n.words = n.text.count(" ") + 1
            n.stops = sum(n.text.count(c) for c in ".!?,;")
    for k in range(len(nodes) - 1, 0, -1):
        up, n = nodes[nodes[k].parent], nodes[k]
        up.chars, up.linked, up.words, up.stops = up.chars + n.chars, up.linked + n.linked, up.words + n.words, up.stops + n.stops
    for n in nodes:
        share = 4 * n.linked // n.chars if n.chars else 0
        size = min(4, n.words.bit_length() // 2)
        n.features = (f"hint={n.hint}",) if n.tag != "#" else (f"links={share}", f"size={size}", f"stops={min(3, 10 * n.stops // max(1, n.words))}")


def group(n: Node) -> str:
    """The kind of element that selects a node's potentials; what is never shown is a kind that tells its parent nothing."""
    if n.unseen:
        return "hidden"
    return "text" if n.tag == "#" else _GROUP.get(n.tag, "inline" if n.tag in INLINE else "box")


class Model:
    """Log potentials: of a label given the parent's label and the kind of element, and of features given label and kind."""

    def __init__(self, prior: tuple[float, float], edge: dict, node: dict):
        self.prior, self.edge, self.node = prior, edge, node

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's content marginal by sum-product: one upward and one downward pass."""
        kinds = [group(n) for n in nodes]
        belief = [[0.0, 0.0] for _ in nodes]  # log potential of the subtree for either label
        message = [(0.0, 0.0)] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            own = belief[k]
            for f in nodes[k].features:
                a, b = self.node.get((kinds[k], f), (0.0, 0.0))
                own[0] += a
                own[1] += b
            if k:
                edge = self.edge.get(kinds[k], self.edge["box"])
                up = tuple(_log_sum(edge[p][0] + own[0], edge[p][1] + own[1]) for p in (0, 1))
                message[k] = up
                above = belief[nodes[k].parent]
                above[0] += up[0]
                above[1] += up[1]
        outside = [(0.0, 0.0)] * len(nodes)
        outside[0] = self.prior
        out = [0.0] * len(nodes)
        for k in range(len(nodes)):
            if k:
                p = nodes[k].parent
                rest = [outside[p][x] + belief[p][x] - message[k][x] for x in (0, 1)]
                edge = self.edge.get(kinds[k], self.edge["box"])
                down = [_log_sum(rest[0] + edge[0][y], rest[1] + edge[1][y]) for y in (0, 1)]
                top = max(down)
                outside[k] = (down[0] - top, down[1] - top)
            a, b = outside[k][0] + belief[k][0], outside[k][1] + belief[k][1]
            out[k] = 1 / (1 + math.exp(min(700, a - b)))
        return out


def _log_sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def train(pages: Iterable[str], smoothing: float = 0.5) -> Model:
    """Potentials from pages whose elements carry data-label="content" or "boilerplate"; children without one take the parent's."""
    edge = defaultdict(lambda: [[smoothing, smoothing], [smoothing, smoothing]])
    node = defaultdict(lambda: [smoothing, smoothing])
    total = defaultdict(lambda: [1.0, 1.0])
    for page in pages:
        nodes = parse(page)
        observe(nodes)
        labels = [0] * len(nodes)
        for k, n in enumerate(nodes):
            labels[k] = int(n.label == "content") if n.label else labels[n.parent] if k else 0
            kind = group(n)
            if k:
                edge[kind][labels[n.parent]][labels[k]] += 1
            total[kind][labels[k]] += 1
            for f in n.features:
                node[kind, f][labels[k]] += 1
    log = math.log
    edges = {g: [[log(x / sum(row)) for x in row] for row in rows] for g, rows in edge.items()}
    edges["hidden"] = [[log(0.5)] * 2] * 2
    return Model((0.0, log(0.01)), edges, {(g, f): tuple(log(c / t) for c, t in zip(n, total[g])) for (g, f), n in node.items()})


def labelled_pages(count: int = 400, seed: int = 7) -> list[str]:
    """Labelled training pages from a seeded layout grammar: site frames, menus, notices, adverts, forms, articles, comments."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    mark = lambda: r.choice([".", ".", ".", "!", "?", " |", "&amp;&amp;", "%%%", "###"])
    sentences = lambda a, b: " ".join(words(3, 14).capitalize() + mark() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    no, yes = 'data-label="boilerplate"', 'data-label="content"'

    def box(tag: str, hint: str, body: str) -> str:
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        return f"<{tag} {no}>{body}</{tag}>" if plain else f'<{tag} class="{r.choice(HINTS[hint].split())}" {no}>{body}</{tag}>'

    def menu():
        return box(r.choice(["nav", "nav", "div", "ul"]), "menu", links(2, 12))

    def paragraph():
        kind = r.random()
        body = sentences(1, 8)
        if kind < 0.15:
            body = f"<b>{body}" + r.choice(["</b>", "<br>", ""])
        elif kind < 0.3:
            body += f" {link()} {words(2, 9)}"
        elif kind < 0.36:
            return f"<ul>{''.join(f'<li>{words(2, 14)}</li>' for _ in range(r.randint(2, 5)))}</ul>"
        elif kind < 0.42:
            return f"<blockquote><p>{body}</p></blockquote>"
        elif kind < 0.46:
            return f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 6)}</td></tr></table>"
        elif kind < 0.52:
            return f"<h{r.randint(2, 4)}>{words(2, 8)}</h2>"
        elif kind < 0.56:
            return box("div", r.choice(["advert", "side", "notice"]), sentences(1, 2)) + f"<p>{body}</p>"
        elif kind < 0.6:
            return box(r.choice(["aside", "form"]), r.choice(["side", "form"]), sentences(1, 2)) + f"<p>{body}</p>"
        return f"<p>{body}</p>"

    def article():
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        named = f' class="{r.choice(HINTS["main"].split())}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        head = r.choice(["", f"<h1>{words(3, 9)}</h1>", f"<h1>{words(3, 9)}</h1>", f"<h2>{words(3, 9)}</h2>"])
        inner = head + "".join(paragraph() for _ in range(r.randint(1, 12)))
        return f"<{tag}{named} {yes}>{inner}</{tag}>" if r.random() < 0.8 else f"<main {yes}><{tag}{named}>{inner}</{tag}></main>"

    def extra():
        kind = r.choice(["advert", "side", "notice", "talk", "form", "frame", "menu"])
        tag = {"form": "form", "side": r.choice(["aside", "div"]), "frame": r.choice(["header", "div"])}.get(kind, r.choice(["div", "section"]))
        body = links(2, 6) if r.random() < 0.3 else "".join(f"<p>{sentences(1, 3)}</p>" for _ in range(r.randint(1, 4))) if r.random() < 0.5 else sentences(1, 3)
        return menu() if kind == "menu" else box(tag, kind, body)

    pages = []
    for _ in range(count):
        foot = box("footer", "frame", r.choice(["&copy; ", ""]) + sentences(1, 2) + (links(1, 4) if r.random() < 0.4 else ""))
        body = menu() + "".join(extra() for _ in range(r.randint(0, 3))) + article() + "".join(extra() for _ in range(r.randint(0, 3))) + foot
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["site", "page", "wrapper", "container"])}">{body}</div>'
        if r.random() < 0.3:
            body = box("header", "frame", f"<h1>{words(1, 3)}</h1>" + (menu() if r.random() < 0.5 else "")) + body
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(page: str, model: Model | None = None) -> str:
    """The main text of a page: kept blocks in page order, white space within a block as one space, blocks two newlines apart."""
    nodes = parse(page)
    observe(nodes)
    marginals = (model or default_model()).marginals(nodes)
    shown = [True] * len(nodes)
    block = [0] * len(nodes)  # the nearest block element
    blocks: list[str] = []
    now, parts = -1, []
    for k, n in enumerate(nodes):
        if k:
            shown[k] = shown[n.parent] and not n.unseen
            block[k] = block[n.parent] if n.tag == "#" or n.tag in INLINE else k
        if n.tag == "#":
            if block[k] != now:
                blocks.append(" ".join("".join(parts).split()))
                now, parts = block[k], []
            if shown[k] and (n.text == " " or marginals[k] >= 0.5):
                parts.append(n.text)
        elif n.tag == "br":
            parts.append(" ")
        elif n.tag not in INLINE:
            blocks.append(" ".join("".join(parts).split()))
            now, parts = k, []
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Main text of each row's whole page: page_id, url, text, n_chars (code points).

    A null or empty page gives the empty text, as does one without content. Rows that repeat an id each give a row; an empty
    table gives none; other columns are not read. Each page is handled by itself, so nothing is shuffled.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    own = model or default_model()

    def rows_of(batch):
        for page_id, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, 2)):
            text = extract(page, own)
            yield page_id, url, text, len(text)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(lambda batches: arrow_rows(batches, rows_of, schema), "page_id long, url string, text string, n_chars long")
