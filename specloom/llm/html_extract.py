"""HTML main text by a tree-structured graphical model.

Block-level DOM elements are the nodes of a tree, each with a hidden state: content (it is, or holds, main text) or
boilerplate. A node's evidence (tag, names in class, id and role, link density, length, sentence marks) and the
potentials between parent and child are counted, with smoothing, on labelled pages. Sum-product message passing, once
upward and once downward, gives every node's marginal; the text blocks of nodes whose content marginal is at least one
half are the main text.

Elements without text of the article (scripts, form controls, fallbacks of media) are left out whole. Those that HTML
reads as raw text run to the end of the page if they are not closed; of the others an unclosed or self-closing tag is
passed over, and what follows it is read on. Text inside svg, math and object is kept like any other (an svg's title
and description are not). A head ends at its end tag, at body, or at the first tag or text that cannot stand in it.

Defined results: null and empty html give an empty text; white space is what str.isspace counts; broken markup is read
leniently (implied end tags, end of input closes all); line breaks within a block are white space; repeated rows are
rows of their own; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds of elements (fixed values of the HTML standard).
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("noscript template select button datalist audio video canvas desc".split())
PHRASING = frozenset("select button datalist".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template noframes".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("caption",)}
WALLS = frozenset("ul ol dl table body html div section article".split())

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ENDS = {t: re.compile(r"</" + t + r"(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW | LEFT_OUT}
_NEXT = {t: re.compile(r"<(/?)(" + "|".join(sorted({t} | (BLOCKS if t in PHRASING else frozenset()), key=lambda x: (-len(x), x))) + r")(?=[\s/>])", re.I) for t in LEFT_OUT}
_LABEL = re.compile(r"data-label=\"([01])\"")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "names", "label", "chars", "linked", "stops", "children", "order")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.chars, self.linked, self.stops, self.children = tag, parent, 0, 0, 0, []
        self.names = tuple(sorted({w for m in _NAMES.finditer(attributes) for g in m.groups() if g for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", g).lower())}))
        found = _LABEL.search(attributes)
        self.label = int(found[1]) if found else None
        if parent:
            parent.children.append(self)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All block nodes, parents first, and the text blocks in page order with the node that holds each."""
    root = Node("#root", None)
    nodes, blocks, stack, buffer = [root], [], [root], []
    linked, at, head = 0, 0, False

    def flush() -> None:
        if buffer:
            text = " ".join(_html.unescape("".join(x for x, _ in buffer)).split())
            if text:
                links = sum(len(x) for x, a in buffer if a)
                total = sum(len(x) for x, _ in buffer) or 1
                node = stack[-1]
                blocks.append((node, text))
                stops = text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
                while node:
                    node.chars += len(text)
                    node.linked += len(text) * links / total
                    node.stops += stops
                    node = node.parent
            buffer.clear()

    def close(tags: tuple) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in WALLS:
                return

    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            head = head and not page[at:end].strip()
            if not head:
                buffer.append((page[at:end], linked > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if head and tag not in IN_HEAD:
            head = False
        if tag == "head":
            head = not closing
        elif tag in RAW and not closing:
            stop = _ENDS[tag].search(page, at)
            at = stop.end() if stop else len(page)
            buffer.append((" ", False))
        elif tag in LEFT_OUT and not closing:
            at = _left_out(page, at, tag)
            if tag not in PHRASING:
                buffer.append((" ", False))
        elif tag == "a":
            linked = 0 if closing else 1
        elif tag in ("br", "wbr", "img"):
            buffer.append((" ", False) if tag != "wbr" else ("", False))
        if tag in BLOCKS and not head:
            if closing:
                if any(n.tag == tag for n in stack[1:]):
                    flush()
                    while stack[-1].tag != tag:
                        stack.pop()
                    stack.pop()
                    linked = 0
                continue
            flush()
            linked = 0
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in WALLS:
                    break
            if tag in CLOSES:
                close(CLOSES[tag])
            node = Node(tag, stack[-1], attributes)
            nodes.append(node)
            if tag not in VOID:
                stack.append(node)
    flush()
    return nodes, blocks


def _left_out(page: str, at: int, tag: str) -> int:
    """Where an element that is left out ends; at itself if it is not closed before another begins (or a block, in a
    form control, which can hold none). Templates may hold each other."""
    depth = 1
    for m in _NEXT[tag].finditer(page, at):
        if m[2].lower() != tag or (not m[1] and tag != "template"):
            break
        depth += -1 if m[1] else 1
        if not depth:
            return _ENDS[tag].match(page, m.start()).end()
    return at


def evidence(n: Node) -> list[tuple[str, str]]:
    """The observed features of a node as (kind, value)."""
    share = n.linked / n.chars if n.chars else 0.0
    size = sum(n.chars >= k for k in (1, 25, 80, 250, 1000))
    out = [("tag", n.tag), ("links", str(sum(share > x for x in (0.0, 0.3, 0.7)))), ("size", str(size)), ("stops", str(min(2, n.stops)))]
    return out + [("name", w) for w in n.names]


class Model:
    """Log potentials: evidence given a state, a child's state given its parent's, the root's state."""

    def __init__(self):
        self.seen: dict = {}
        self.step = [[1.0, 0.02], [1.0, 1.0]]

    def fit(self, pages: list[str]) -> Model:
        counts: dict = {}
        for page in pages:
            nodes, _ = parse(page)
            labels = {}
            for n in nodes:
                y = labels[n] = 1 if n.label is None and n.parent is None else labels[n.parent] if n.label is None else n.label
                if n.parent:
                    self.step[labels[n.parent]][y] += 1
                for e in evidence(n):
                    counts.setdefault(e, [0, 0])[y] += 1
        kinds: dict = {}
        for (kind, _), c in counts.items():
            t = kinds.setdefault(kind, [0, 0, 0])
            t[0] += c[0]
            t[1] += c[1]
            t[2] += 1
        for (kind, value), c in counts.items():
            t = kinds[kind]
            self.seen[kind, value] = tuple(math.log((c[y] + 0.5) / (t[y] + 0.5 * (t[2] + 1))) for y in (0, 1))
        self.step = [[math.log(x / sum(row)) for x in row] for row in self.step]
        return self

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content | page) per node: messages from the leaves up, then from the root down."""
        step, seen = self.step, self.seen
        for k, n in enumerate(nodes):
            n.order = k
        own = []
        for n in nodes:
            a = b = 0.0
            for e in evidence(n):
                p = seen.get(e)
                if p:
                    a += p[0]
                    b += p[1]
            own.append([a, b])
        up = [None] * len(nodes)  # message of a node to its parent, by the parent's state
        total = [row[:] for row in own]  # evidence at and below a node
        for k in range(len(nodes) - 1, 0, -1):
            t = total[k]
            m = up[k] = [_add(t[0] + step[p][0], t[1] + step[p][1]) for p in (0, 1)]
            parent = total[nodes[k].parent.order]
            parent[0] += m[0]
            parent[1] += m[1]
        belief = [None] * len(nodes)
        belief[0] = total[0]
        for k in range(1, len(nodes)):
            b, m = belief[nodes[k].parent.order], up[k]
            out = [b[0] - m[0], b[1] - m[1]]  # what the parent knows without this child
            down = [_add(out[0] + step[0][y], out[1] + step[1][y]) for y in (0, 1)]
            belief[k] = [total[k][0] + down[0], total[k][1] + down[1]]
        return [1.0 / (1.0 + math.exp(min(700.0, max(-700.0, b[0] - b[1])))) for b in belief]


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


#: Names that pages commonly give to their parts (fixed values), for the labelled pages.
PARTS = {
    "menu": ("nav", "ul"), "navigation": ("nav", "div"), "navbar": ("div", "nav"), "breadcrumb": ("div", "nav", "ol"), "site-header": ("header", "div"), "masthead": ("div", "header"), "topbar": ("div",),
    "ad": ("div", "aside", "section"), "advert": ("div",), "advertisement": ("div", "aside"), "ads banner": ("div",), "sponsored promo": ("div", "section"), "sidebar": ("aside", "div"), "widget": ("div", "aside"), "related": ("section", "div", "aside"), "recommended more": ("div",), "popular trending": ("div", "aside"),
    "cookie-notice": ("div", "section"), "consent": ("div",), "notice": ("div", "aside"), "alert": ("div",), "gdpr banner": ("div",), "popup modal": ("div",), "newsletter subscribe": ("div", "form", "section"), "signup": ("form", "div"), "search": ("form", "div"), "login": ("form",),
    "social share": ("div", "ul"), "tags meta": ("div", "ul"), "comments": ("section", "div", "ol"), "comment-list": ("ol", "ul", "div"), "reader-comments": ("section", "div"), "comment": ("div", "li", "article"), "disqus thread": ("div",), "responses": ("section",), "footer": ("footer", "div"), "site-footer copyright": ("footer", "div"), "legal disclaimer": ("div", "footer"), "pagination pager": ("div", "nav"),
}
CONTENT = ("content", "article-body", "post", "entry-content", "main", "story", "text", "post-content", "article", "page-content", "body-copy", "article__body")


def labelled_pages(n: int = 400, seed: int = 42) -> list[str]:
    """n labelled pages drawn from a fixed seed (a bounded sample by design); data-label marks each part's state."""
    r = random.Random(seed)
    syllables = "ing tion the er on re an es en th ou le de la eau ment ier que ung sch heit ich ver ge be mente ar os ll do ra si no ta".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    sentence = lambda: " ".join(word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(1, 24))).capitalize() + r.choice(".....!?")
    prose = lambda k: " ".join(sentence() for _ in range(r.randint(1, k)))
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 4)))}</a>'

    def paragraph(tag: str = "p") -> str:
        if r.random() < 0.1:
            return f"<{tag}><b>{prose(3)}<br>"
        text = prose(r.choice([1, 1, 3, 8, 20])) if r.random() < 0.8 else " ".join(word() for _ in range(r.choice([1, 1, 2, 5, 30, 200])))
        if r.random() < 0.15:
            text += " " + link() + " " + sentence()
        return f"<{tag}>{text}</{tag}>"

    def boiler() -> str:
        name, tags = r.choice(list(PARTS.items()))
        tag = r.choice(tags)
        attribute = f' {r.choice(["class", "class", "id"])}="{name}"' if r.random() < (0.5 if tag in ("nav", "footer", "header", "aside", "form") else 1.0) else ""
        kind = r.random()
        if "comment" in name or name in ("responses", "disqus thread"):
            inner = "".join(f"<div class=\"{r.choice(['comment', 'reply', 'comment-body'])}\"><p>{prose(4)}</p></div>" for _ in range(r.randint(1, 4)))
            inner = r.choice(["<h3>Comments</h3>", ""]) + (inner if r.random() < 0.7 else f"<p>{prose(4)}</p>" * 2)
        elif tag in ("ul", "ol") or kind < 0.45:
            items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif tag == "form":
            inner = f"<label>{word()}</label><input name=q><button>{word()}</button><p>{sentence()}</p>"
        elif kind < 0.7:
            inner = sentence()
        else:
            inner = f"<h3>{word()}</h3><p>{prose(2)}</p>" + (link() if r.random() < 0.5 else "")
        return f'<{tag}{attribute} data-label="0">{inner}</{tag}>'

    def content() -> str:
        body = [f"<h1>{sentence()}</h1>" if r.random() < 0.85 else ""]
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.75:
                body.append(paragraph())
            elif k < 0.82:
                body.append(f"<h2>{' '.join(word() for _ in range(4))}</h2>")
            elif k < 0.88:
                body.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>")
            elif k < 0.92:
                body.append(f"<blockquote><p>{prose(2)}</p></blockquote>")
            elif k < 0.95:
                body.append(f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>")
            else:
                body.append(boiler())
        tag = r.choice(["article", "article", "main", "div", "section"])
        attribute = f' class="{r.choice(CONTENT)}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        inner = "".join(body)
        return f'<{tag}{attribute} data-label="1">{inner}</{tag}>'

    pages = []
    for _ in range(n):
        parts = [boiler() for _ in range(r.randint(1, 4))] + [content()] + [boiler() for _ in range(r.randint(1, 4))]
        inner = "".join(parts)
        if r.random() < 0.4:
            inner = f'<div id="{r.choice(["wrapper", "page", "container", "root", "app"])}" data-label="1">{inner}</div>'
        pages.append(f"<html><head><title>x</title></head><body>{inner}</body></html>")
    return pages


_fitted: dict = {}


def model(n: int = 400, seed: int = 42) -> Model:
    if (n, seed) not in _fitted:
        _fitted[n, seed] = Model().fit(labelled_pages(n, seed))
    return _fitted[n, seed]


def extract_text(page: str, fitted: Model) -> str:
    nodes, blocks = parse(page)
    p = fitted.marginals(nodes)
    return "\n\n".join(text for node, text in blocks if p[node.order] >= 0.5)


def extract(pages: DataFrame, fitted: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars per page."""
    fitted = fitted or model()

    def run(batches):
        for batch in (part.slice(i, 256) for part in batches for i in range(0, part.num_rows, 256)):
            texts = [extract_text(x, fitted) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extract": op6_html_extract}
ORACLES: dict[str, str] = {}
