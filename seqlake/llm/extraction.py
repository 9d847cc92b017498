"""Main-text extraction: gradient-boosted trees over DOM-node features.

A page is parsed into a tree of block elements; every block gets features of
its text and links, the density of its subtree, its tag and attribute tokens,
its depth and its siblings. Boosted regression trees (logistic loss, Newton
leaves) score how likely a block belongs to the article. Decoding goes down
the tree: a node either takes its children's best choices or drops its whole
subtree, whichever fits the scores of the text in it better, so that no
text is kept inside a dropped ancestor.

The trees are fitted on pages that are composed here (``training_pages``)
from article and boilerplate parts with known labels, in many layouts; the
number of pages is a bounded parameter. No page of the input is used.

Text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one line break.

Defined cases: a null or empty page, or one without article text, gives an
empty text; unclosed, crossed and unknown tags are read as a browser would,
as far as blocks are concerned, but for hidden elements that are never closed,
which end with the block around them (scripts and styles with the page); text outside any element is a block of its
body; repeated rows give equal texts; a null id or url stays null; an empty
table gives an empty result; very long pages are read whole; other columns
are ignored.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import spread

TRAINING_PAGES, TRAINING_SEED = 400, 11
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 24

# Element names of the HTML standard, by the part they play here.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map select textarea button datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split()
)
#: Opening one of the first closes an open one of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
#: Tokens of id, class and role that speak for or against an article.
GOOD = frozenset("article body content entry main post story text blog page".split())
BAD = frozenset(
    "ad ads advert advertisement banner bar breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer foot form "
    "header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related reply respond share sharing "
    "sidebar side signup social sponsor sponsored subscribe tags teaser toolbar widget alert".split()
)
#: A quote opens a value only after an equals sign; elsewhere it is a character of the tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(id|class|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Parts of a name that take back what the rest of it says: "advert-free", "no-sidebar", "has-sidebar".
_TAKEN_BACK = re.compile(r"(?:^|[-_])(?:no|non|free|without|has|with|hide)(?:$|[-_])", re.I)
_OPENS = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in HIDDEN}
#: Hidden elements that may hold others of their name, or page blocks.
_NESTING = frozenset(("svg", "math", "object", "template", "map", "head"))
_RAW_END = {name: re.compile(rf"</{name}\s*/?>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_SPACE = re.compile(r"[\s]+")


class Node:
    """A block element. ``parts`` holds its text blocks and its block children, in page order."""

    __slots__ = ("tag", "parent", "parts", "tokens", "hidden", "links", "chars", "linked", "blocks", "nodes", "marks")

    def __init__(self, tag: str, parent: Node | None, tokens=frozenset(), hidden: bool = False):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.hidden = hidden
        self.parts: list = []


class Block:
    """A run of inline text."""

    __slots__ = ("text", "linked", "links", "parent")

    def __init__(self, text: str, linked: int, links: int, parent: Node):
        self.text, self.linked, self.links, self.parent = text, linked, links, parent


def parse(page: str) -> Node:
    """The tree of block elements of a page."""
    root = node = Node("html", None)
    pieces: list[str] = []
    links = linked = 0
    in_link = False
    skip: list[str] = []  # open elements whose text isn't shown
    inside: list[str] = []  # blocks opened in them
    ends: dict[str, tuple[int, bool]] = {}  # by name, the next tag of a hidden element, and whether it closes one

    def closes(name: str, at: int) -> bool:
        """Whether a hidden element that opens before ``at`` is ever closed, and not only another one after it."""
        place, closing = ends.get(name, (-1, False))
        if place < at:
            tag = _OPENS[name].search(page, at)
            if name in _NESTING:
                while tag and not tag[1]:
                    tag = _OPENS[name].search(page, tag.end())
            place, closing = ends[name] = (tag.start(), bool(tag[1])) if tag else (len(page), False)
        return closing

    def flush() -> None:
        nonlocal links, linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                node.parts.append(Block(text, min(linked, len(text)), links, node))
            pieces.clear()
        links = linked = 0

    at = 0
    while at < len(page):
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and not skip:
            pieces.append(text)
            if in_link:
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if not closing and name in _RAW_END and "svg" not in skip:
            end = _RAW_END[name].search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            elif name in ("title", "textarea"):  # never closed: its text ends at the next tag
                at = page.find("<", at) if "<" in page[at:] else len(page)
            continue
        if name in HIDDEN:
            if closing:
                if name in skip:
                    del skip[len(skip) - 1 - skip[::-1].index(name) :]
            elif not found[3].rstrip().endswith("/") and closes(name, at):
                skip.append(name)
            if not skip:
                inside.clear()
            continue
        if skip and name == "foreignobject":
            inside.append(name) if not closing else inside and inside.pop()
        if skip and name in BLOCK:
            # a hidden element that was never closed ends with the block around it, a drawing at the first block in it
            if closing and name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name) :]
            elif closing and any(True for _ in _upwards(node, name)) or not closing and (name == "body" or skip[-1] in ("svg", "math") and "foreignobject" not in inside):
                skip.clear()
                inside.clear()
            elif not closing:
                inside.append(name)
        if skip:
            continue
        if name == "a":
            in_link = not closing
            links += not closing
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK:
            if closing:
                up = node
                while up is not None and up.tag != name:
                    up = up.parent
                if up is not None and up.parent is not None:
                    flush()
                    node = up.parent
                elif name == "p":
                    flush()
                continue
            flush()
            if name in ("html", "body") and any(True for _ in _upwards(node, name)):
                continue
            if node.tag == "p" or any(x.tag == "p" for x in _until(node, ("div", "li", "td", "th", "article", "section", "blockquote", "body"))):
                while node.tag != "p":
                    node = node.parent
                node = node.parent
            if name in CLOSES:
                up = node
                while up.tag not in CLOSES[name] and up.tag not in ("ul", "ol", "dl", "table", "body", "html", "menu"):
                    up = up.parent
                while up.tag in CLOSES[name] and up.parent is not None:
                    up = up.parent
                    node = up
            if name == "hr":
                continue
            tokens, hidden = _attributes(found[3])
            child = Node(name, node, tokens, hidden)
            node.parts.append(child)
            node = child
    flush()
    return root


def _upwards(node: Node, tag: str):
    while node is not None:
        if node.tag == tag:
            yield node
        node = node.parent


def _until(node: Node, stops: tuple[str, ...]):
    while node is not None and node.tag not in stops:
        yield node
        node = node.parent


def _attributes(raw: str) -> tuple[frozenset, bool]:
    tokens, hidden = set(), False
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key in ("id", "class", "role", "itemprop"):
            for word in value.split():
                own = {t.lower() for t in _TOKEN.findall(word)}
                tokens.update(own - BAD if _TAKEN_BACK.search(word) else own)
    return frozenset(tokens), hidden


# ------------------------------------------------------------------ features

_TAGS = ("p", "li", "td", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote", "ul", "body")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
N_FEATURES = 27 + 2 * len(_TAGS)
_SHUT = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"))


def _measure(node: Node) -> None:
    """Characters, linked characters, blocks, nodes and sentence marks of each subtree, without deep recursion."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [p for p in n.parts if isinstance(p, Node)]
    for n in reversed(order):
        n.chars = n.linked = n.links = n.blocks = n.marks = 0
        n.nodes = 1
        for p in n.parts:
            if isinstance(p, Node):
                n.chars += p.chars
                n.linked += p.linked
                n.links += p.links
                n.blocks += p.blocks
                n.nodes += p.nodes
                n.marks += p.marks
            else:
                n.chars += len(p.text)
                n.linked += p.linked
                n.links += p.links
                n.blocks += 1
                n.marks += p.text.count(".") + p.text.count(",") + p.text.count("!") + p.text.count("?")


def blocks_of(root: Node) -> tuple[list[Block], np.ndarray]:
    """The text blocks of a page in order, and a row of features for each."""
    _measure(root)
    blocks: list[Block] = []
    rows: list[list[float]] = []
    # node, good and bad tokens above, article above, shutting tag above, hidden, depth, and the nearest node above that
    # has other parts, too: an element around a single other one changes nothing
    stack: list = [(root, 0, 0, 0, 0, 0, 0, root)]
    total = max(1, root.chars)
    while stack:
        item = stack.pop()
        if isinstance(item, list):
            rows.append(item[1])
            blocks.append(item[0])
            continue
        node, good, bad, article, shut, hidden, depth, up = item
        good += len(node.tokens & GOOD)
        bad += len(node.tokens & BAD)
        article += node.tag in ("article", "main")
        shut += node.tag in _SHUT
        hidden += node.hidden
        count = len(node.parts)
        deeper, above = (depth + 1, node) if count > 1 else (depth, up)
        texts = sum(isinstance(p, Block) for p in node.parts)
        todo = []
        for i, p in enumerate(node.parts):
            if isinstance(p, Node):
                todo.append((p, good, bad, article, shut, hidden, deeper, above))
                continue
            n = len(p.text)
            words = p.text.count(" ") + 1
            marks = sum(p.text.count(c) for c in ".,!?")
            row = [
                n, words, p.linked / n, p.links, marks / words, p.text[-1] in ".!?:…\"'”»)", sum(map(str.isdigit, p.text)) / n,
                node.tag in _HEADINGS, good, bad, article, shut, hidden, depth, count, texts, i / count,
                node.chars / node.nodes, node.linked / max(1, node.chars), up.chars / up.nodes, up.linked / max(1, up.chars), up.marks / max(1, up.blocks),
                len(up.parts), up.chars / total, len(node.tokens & BAD) > 0, len(up.tokens & BAD) > 0, "©" in p.text,
                *(node.tag == t for t in _TAGS), *(up.tag == t for t in _TAGS),
            ]
            todo.append([p, [float(x) for x in row]])
        stack += reversed(todo)
    return blocks, np.array(rows, dtype=np.float32).reshape(len(rows), N_FEATURES)


# ------------------------------------------------------------- boosted trees


class Boosted:
    """Gradient-boosted regression trees on binned features, for the logistic loss."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(len(y), self.start)
        self.model = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(len(y), dtype=int)
            for node in range(size):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                g, w = gradient[own].sum(), weight[own].sum()
                value[node] = self.rate * g / (w + 1.0)
                if 2 * node + 2 >= size or len(own) < 10:
                    continue
                best = 1e-3
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[own, f], gradient[own], len(c) + 1))[:-1]
                    left_w = np.cumsum(np.bincount(binned[own, f], weight[own], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_w + 1) + (g - left_g) ** 2 / (w - left_w + 1) - g * g / (w + 1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[node], cut[node] = gain[i], f, c[i]
                if feature[node] >= 0:
                    at[own] = np.where(x[own, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
            score += value[at]
            self.model.append((feature, cut, value))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, cut, value in self.model:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[every, np.maximum(f, 0)] <= cut[at], 2 * at + 1, 2 * at + 2))
            out += value[at]
        return out


# ------------------------------------------------------------- training pages


def training_pages(n: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> list[tuple[str, list[str]]]:
    """Pages with the texts of their article blocks."""
    rnd = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v k sh ch th é ü ñ".split() for b in "a e i o u en er an on".split()]

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.choice((1, 1, 2, 2, 3))))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(low, high)))

    def sentence() -> str:
        mark = rnd.choice((".", ".", ".", "!", "?"))
        noise = rnd.random()
        body = words(3, 18)
        if noise < 0.1:
            body = ", ".join(words(1, 5) for _ in range(3))
        elif noise < 0.16:
            body = " ".join(w + rnd.choice(("***", "$$$", "%%%", "###", "!!")) for w in body.split())
        return body.capitalize() + mark

    def prose(low: int = 1, high: int = 8) -> str:
        return " ".join(sentence() for _ in range(rnd.randint(low, high)))

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{word()}">{words(low, high)}</a>'

    def attribute(*names: str) -> str:
        how = rnd.random()
        name = rnd.choice(names)
        if how < 0.25:
            return ""
        extra = rnd.choice(("", "", " " + word(), "-" + word(), " col-8"))
        return f' {rnd.choice(("class", "id"))}="{name}{extra}"'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 9)))
        tag = rnd.choice(("nav", "nav", "div", "header"))
        return f"<{tag}{attribute('nav', 'menu', 'navbar', 'breadcrumbs')}><ul>{items}</ul></{tag}>"

    def header() -> str:
        tag = rnd.choice(("header", "header", "div"))
        name = "masthead" if tag == "div" else ""
        return f"<{tag}{f' class={name}' if name else attribute('header', 'top')}><h2>{words(1, 4)}</h2><p>{words(2, 8)}</p></{tag}>"

    def footer() -> str:
        tag = rnd.choice(("footer", "footer", "footer", "div"))
        name = "footer" if tag == "div" else ""
        body = rnd.choice((f"&copy; {word()}.example.com &middot; {prose(1, 2)}", f"<p>&copy; 20{rnd.randint(10, 26)} {words(1, 4)}. {prose(0, 2) if rnd.random() < 0.5 else ''}</p>", f"{link()} {link()} {words(2, 6)}", prose(1, 3)))
        return f"<{tag}{f' class={name}' if name else attribute('footer', 'site-footer')}>{body}</{tag}>"

    def advert() -> str:
        body = rnd.choice((prose(1, 3), f"<p>{prose(1, 3)}</p>", link(3, 8), f"<h3>{words(2, 4)}</h3><p>{prose(1, 2)}</p>"))
        return f'<{(t := rnd.choice(("div", "div", "aside", "section")))} {rnd.choice(("class", "id"))}="{rnd.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-box", "banner"))}">{body}</{t}>'

    def notice() -> str:
        tag = rnd.choice(("div", "section", "aside"))
        return f'<{tag} class="{rnd.choice(("notice", "cookie-banner", "cookies", "consent", "alert", "newsletter", "popup"))}"><p>{prose(1, 3)}</p>{rnd.choice(("", "<button>ok</button>", link()))}</{tag}>'

    def sidebar() -> str:
        tag = rnd.choice(("aside", "aside", "div"))
        name = "sidebar" if tag == "div" else rnd.choice(("", "", "sidebar", "related"))
        items = "".join(rnd.choice((f"<li>{link(2, 6)}</li>", f"<p>{prose(1, 2)}</p>", f"<div>{words(3, 9)}</div>")) for _ in range(rnd.randint(1, 6)))
        return f'<{tag}{f" class={name}" if name else ""}><h3>{words(1, 3)}</h3>{items}</{tag}>'

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(1, 4)}</label><input name=q><p>{prose(1, 2)}</p><button>{word()}</button></form>'

    def comments() -> str:
        each = "".join(f'<{(t := rnd.choice(("li", "div", "article")))} class="comment"><b>{word()}</b> <p>{prose(1, 5)}</p></{t}>' for _ in range(rnd.randint(1, 5)))
        tag = rnd.choice(("section", "div", "ol"))
        return f'<{tag} {rnd.choice(("class", "id"))}="{rnd.choice(("comments", "comment-list", "replies respond", "disqus comments"))}"><h3>{words(1, 3)}</h3>{each}</{tag}>'

    out = []
    for _ in range(n):
        kept: list[str] = []

        def keep(text: str) -> str:
            kept.append(_SPACE.sub(" ", text).strip())
            return html.escape(text, quote=False)

        def paragraph() -> str:
            how = rnd.random()
            if how < 0.72:
                return f"<p>{keep(prose(1, 8))}</p>"
            if how < 0.78:
                return f"<p>{keep(words(1, 4).capitalize() + '.')}</p>"
            if how < 0.83:
                return f"<h2>{keep(words(1, 6))}</h2>"
            if how < 0.88:
                return "<ul>" + "".join(f"<li>{keep(prose(1, 2))}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
            if how < 0.92:
                return f"<blockquote>{keep(prose(1, 3))}</blockquote>"
            if how < 0.96:
                a, b, c = prose(1, 2), words(1, 3), prose(1, 2)
                keep(f"{a} {b} {c}")
                return f'<p>{a} <a href="/x">{b}</a> {c}</p>'
            return "<table><tr>" + "".join(f"<td>{keep(words(1, 4))}</td>" for _ in range(3)) + "</tr></table>"

        body = [f"<h1>{keep(words(2, 12))}</h1>"] if rnd.random() < 0.85 else []
        if rnd.random() < 0.2:
            body.append(f"<p><b>{keep(prose(1, 3))}<br>")
        for _ in range(rnd.choice((1, 1, 2, 4, 8, 14))):
            body.append(paragraph())
            if rnd.random() < 0.06:
                body.append(rnd.choice((advert, notice, form))())
        tag = rnd.choice(("article", "article", "article", "main", "div", "section"))
        name = attribute("article", "post", "content", "entry-content", "story") if tag not in ("div", "section") else rnd.choice(("", f' class="{word()}"', *(f' class="{x}"' for x in ("content", "post", "article-body", "main-text", "story"))))
        article = f"<{tag}{name}>{''.join(body)}</{tag}>"
        before = [f() for f in (header, menu, notice, advert, form, sidebar) if rnd.random() < 0.4]
        after = [f() for f in (comments, sidebar, advert, form, menu, notice) if rnd.random() < 0.35] + ([footer()] if rnd.random() < 0.85 else [])
        if rnd.random() < 0.4:
            article, after = f'<div class="{rnd.choice(("wrap", "page", "container", "row"))}">{article}{"".join(after[:1])}</div>', after[1:]
        end = "</body></html>" if rnd.random() < 0.85 else ""
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>x('</p>')</script></head><body>{''.join(before)}<!-- {word()} -->{article}{''.join(after)}{end}"
        out.append((page, kept))
    return out


def trained(n: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Boosted:
    """Trees fitted on ``n`` composed pages."""
    features, labels = [], []
    for page, kept in training_pages(n, seed):
        blocks, rows = blocks_of(parse(page))
        left = list(kept)
        for block in blocks:
            hit = block.text in left
            if hit:
                left.remove(block.text)
            labels.append(hit)
        features.append(rows)
    return Boosted().fit(np.concatenate(features), np.array(labels, dtype=float))


# ------------------------------------------------------------------ decoding


def main_text(page: str | None, model: Boosted) -> str:
    """The article's blocks, joined by line breaks."""
    root = parse(page or "")
    blocks, rows = blocks_of(root)
    return decoded(root, blocks, model.scores(rows)) if blocks else ""


def decoded(root: Node, blocks: list[Block], scores: np.ndarray) -> str:
    """Choose subtrees from the leaves up, then write what no dropped ancestor covers.

    A block is worth its log odds times the root of its length; a node keeps
    its children's choices if they are worth more than dropping it, which is
    worth nothing. Around short text the ancestors' sums decide: a block whose
    own odds are near even follows the blocks beside it.
    """
    own = {id(b): float(s) for b, s in zip(blocks, scores)}
    value: dict[int, float] = {}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    mean: dict[int, tuple[float, float]] = {}
    for node in reversed(order):
        total = weight = 0.0
        for p in node.parts:
            if isinstance(p, Block):
                w = len(p.text) ** 0.5
                total += w * own[id(p)]
                weight += w
            else:
                a, b = mean[id(p)]
                total += a
                weight += b
        mean[id(node)] = total, weight
        gain = 0.0
        for p in node.parts:
            if isinstance(p, Node):
                gain += max(0.0, value[id(p)])
            else:
                # near-even blocks lean on the text of the node around them
                lean = own[id(p)] + 0.5 * max(-2.0, min(2.0, total / weight))
                own[id(p)] = lean
                gain += max(0.0, lean * len(p.text) ** 0.5)
        value[id(node)] = gain
    out = []
    stack = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, Block):
            if own[id(item)] > 0:
                out.append(item.text)
        elif value[id(item)] > 0 and not (item.tag in _SHUT and mean[id(item)][0] < 0):
            stack += reversed(item.parts)
    return "\n".join(out)


def extract(df: DataFrame, n_training: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> DataFrame:
    """page_id, url, text and n_chars of every row (page_id, url, html)."""
    model = df.sparkSession.sparkContext.broadcast(trained(n_training, seed))

    def made(batches):
        for batch in batches:
            ids, urls, texts, kept = batch.column(0), batch.column(1), [], []
            for at in range(0, batch.num_rows, 64):
                pages = batch.column(2).slice(at, 64).to_pylist()
                roots = [parse(p or "") for p in pages]
                found = [blocks_of(r) for r in roots]
                sizes = [len(b) for b, _ in found]
                rows = [r for _, r in found if len(r)]
                scores = model.value.scores(np.concatenate(rows)) if rows else np.zeros(0)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                texts += [decoded(r, b, scores[x:y]) if b else "" for r, (b, _), x, y in zip(roots, found, edges[:-1], edges[1:])]
            kept = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(kept, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(rows).mapInArrow(made, "page_id long, url string, text string, n_chars long")


def op4_boosted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
