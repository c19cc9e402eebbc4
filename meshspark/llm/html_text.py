"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_arrow, only

#: Bounds of the sample of labelled pages that the model is fitted on.
SAMPLE, LONGEST = 400, 20_000
#: Labelled pages drawn by rule that it is fitted on beside them.
DRAWN = 600

# Fixed values of HTML: raw text, void elements, elements inside a line, what a start tag closes.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "xmp", "textarea", "title", "svg", "select", "object", "button"}
CLOSES_ITSELF = {"svg", "select", "object", "button", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "mtext", "msup", "msub", "mfrac", "msqrt", "noscript", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"table", "td", "th", "button", "html", "body"}}

#: Tags and words of class, id and role that are features of their own.
TAGS = ["html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "tr", "td", "th", "nav", "header", "footer", "aside", "form", "fieldset", "address", "details", "dialog", "menu", "span", "a", "head"]
WORDS = ["ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent", "cookie", "copyright", "dialog", "discussion", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "reply", "respond", "search", "share", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget", "article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"]
_TAG, _WORD = {t: i for i, t in enumerate(TAGS)}, {w: len(TAGS) + 1 + i for i, w in enumerate(WORDS)}
_LONG = [w for w in WORDS if len(w) >= 5 or w in ("menu", "nav")]
_SHAPE = len(TAGS) + 1 + len(WORDS)
FEATURES, EDGES = _SHAPE + 18, len(TAGS) + 1
#: Elements whose text is never the article's, whatever their surroundings say in training.
OUTSIDE = {"nav", "aside", "form", "footer", "menu", "dialog", "address", "fieldset"}
#: Words of class, id and role that tell the same.
CLUTTER = ["ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent", "cookie", "copyright", "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "reply", "respond", "search", "share", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"]
REMARKS = ["comment", "comments", "related", "reply"]
MARKS = ("article", "main")

_MARK = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


@dataclass
class Page:
    """Elements in page order (parent before child) and texts: (element, block, string)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    words: list[list[str]] = field(default_factory=lambda: [[]])
    linked: list[int] = field(default_factory=lambda: [0])
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def parsed(source: str) -> Page:
    """A tolerant reading of a page: tags left open or never opened, comments and tags cut by the end.

    Elements inside a line are nodes only with a class, id or role; other text belongs to the element around them.
    """
    page, stack, block, at, links = Page(), [("html", 0)], 0, 0, 0
    opened: Counter = Counter()  # by tag, so that what isn't open is not looked for

    def push(tag: str, node: int) -> None:
        stack.append((tag, node))
        opened[tag] += 1

    def pop_to(names: set[str], scope: set[str]) -> None:
        nonlocal links
        if not any(opened[t] for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                links -= sum(t == "a" for t, _ in stack[i:])
                opened.subtract(t for t, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    def text(piece: str) -> None:
        if piece:
            owner, piece = stack[-1][1], html.unescape(piece)
            if links:
                page.linked[owner] += len(piece.strip())
            page.texts.append((owner, block, piece))

    n = len(source)
    while at < n:
        m = _MARK.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at, whole = m.end(), m[0]
        name = _NAME.match(whole)
        if name is None or (at == n and not whole.endswith(">")):
            continue
        tag = name[1].lower()
        if whole[1] == "/":
            if tag not in INLINE and tag not in RAW:
                block += 1
            pop_to({tag}, set())
            continue
        if tag in RAW:
            if tag not in CLOSES_ITSELF or not whole.endswith("/>"):
                end = _END[tag].search(source, at)
                at = end.start() if end else at if whole.endswith("/>") else n
            continue
        if tag in VOID:
            if tag == "hr":
                block += 1
            elif tag == "br":
                page.texts.append((stack[-1][1], block, " "))
            continue
        if tag == "html":
            continue
        words = [w for a in _ATTRIBUTE.finditer(whole) for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a[2] or a[3] or a[4] or "").lower())]
        if tag in INLINE:
            if tag == "a":
                links += 1
            if not words:
                push(tag, stack[-1][1])
                continue
        else:
            block += 1
            pop_to({"p"}, SCOPE["p"])
            if tag in CLOSED_BY:
                pop_to(CLOSED_BY[tag], SCOPE[tag])
            elif tag == "body":
                pop_to({"head"}, set())
        page.parent.append(stack[-1][1])
        page.tag.append(tag)
        page.words.append(words)
        page.linked.append(0)
        push(tag, len(page.parent) - 1)
    return page


def known_words(words: list[str]) -> set[str]:
    """The WORDS among them, and the longer ones of them that another starts or ends with (commentlist, topnav)."""
    known = {w for w in words if w in _WORD}
    for w in set(words) - known:
        if len(w) > 5:
            known |= {k for k in _LONG if w.startswith(k) or w.endswith(k)}
    return known


def told_outside(tag: str, known: set[str]) -> bool:
    """Words of clutter on an element; bodies and articles are known by few of them."""
    return not known.isdisjoint(REMARKS if tag in MARKS else CLUTTER) and tag != "body"


class Trees:
    """The trees of many pages as one forest, its nodes sorted by depth."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.starts, n = starts, int(starts[-1])
        parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) < 0, 0, s) for p, s in zip(pages, starts, strict=False)] or [np.empty(0, int)]).astype(int)
        depth = np.zeros(n, int)
        own, linked, children = np.zeros(n), np.zeros(n), np.zeros(n)
        x = np.zeros((n, FEATURES), np.float32)
        kind = np.zeros(n, int)
        for p, s in zip(pages, starts, strict=False):
            held, under = [], []  # in an article or main element; in one that tells it is outside
            for i, (tag, words) in enumerate(zip(p.tag, p.words, strict=True)):
                held.append(tag in MARKS or (i > 0 and held[p.parent[i]]))
                if i:
                    depth[s + i] = depth[parent[s + i]] + 1
                    children[parent[s + i]] += 1
                    x[s + i, _SHAPE + 11] = p.tag[p.parent[i]] in ("body", "html")
                kind[s + i] = _TAG.get(tag, len(TAGS))
                known = known_words(words) if words else set()
                for w in known:
                    x[s + i, _WORD[w]] = 1
                x[s + i, _SHAPE + 14] = told = told_outside(tag, known)
                x[s + i, _SHAPE + 15] = tag in OUTSIDE
                x[s + i, _SHAPE + 16] = i > 0 and under[p.parent[i]]
                under.append(told or tag in OUTSIDE or (i > 0 and (under[p.parent[i]] or (tag == "header" and p.tag[p.parent[i]] in ("body", "html")))))
            if any(held):
                x[s : s + len(held), _SHAPE + 12] = held
                x[s : s + len(held), _SHAPE + 13] = ~np.array(held)
            linked[s : s + len(p.linked)] = p.linked
            for owner, _, piece in p.texts:
                own[s + owner] += len(piece.strip())
        x[np.arange(n), kind] = 1
        share = linked / np.maximum(own, 1)
        for j, rule in enumerate((own == 0, (own > 0) & (own < 25), (own >= 25) & (own < 100), (own >= 100) & (own < 400), own >= 400, share > 0.2, share > 0.6, children == 0, (children > 0) & (children < 4), children >= 4, depth <= 1)):
            x[:, _SHAPE + j] = rule
        x[:, -1] = 1
        self.order = np.argsort(depth, kind="stable")
        back = np.empty(n, int)
        back[self.order] = np.arange(n)
        self.place = back
        above = parent[self.order]
        self.parent = np.where(above < 0, -1, back[np.maximum(above, 0)])
        self.x, self.kind = x[self.order], kind[self.order]
        self.levels = np.searchsorted(depth[self.order], np.arange(int(depth.max(initial=0)) + 2))


@dataclass
class Model:
    """unary: FEATURES x 2; pair: kind of child x label of parent x label of child."""

    unary: np.ndarray
    pair: np.ndarray

    def sums(self, t: Trees) -> tuple[np.ndarray, np.ndarray, float]:
        """Sum-product: marginals of nodes (n x 2) and of edges (n x parent x child), and log Z of the forest.

        Messages go up level by level, then down; both exact on trees.
        """
        theta, psi = t.x @ self.unary.astype(np.float32), self.pair[t.kind]
        inside, up = theta.astype(np.float64).copy(), np.zeros((len(theta), 2))
        for d in range(len(t.levels) - 2, 0, -1):
            a, b = t.levels[d], t.levels[d + 1]
            s = psi[a:b] + inside[a:b, None, :]
            up[a:b] = np.logaddexp(s[:, :, 0], s[:, :, 1])
            lo = t.levels[d - 1]
            for v in (0, 1):
                inside[lo:a, v] += np.bincount(t.parent[a:b] - lo, up[a:b, v], a - lo)
        belief = inside.copy()
        edge = np.zeros((len(theta), 2, 2))
        for d in range(1, len(t.levels) - 1):
            a, b = t.levels[d], t.levels[d + 1]
            outside = belief[t.parent[a:b]] - up[a:b]
            s = psi[a:b] + outside[:, :, None] + inside[a:b, None, :]
            belief[a:b] = np.logaddexp(s[:, 0, :], s[:, 1, :])
            edge[a:b] = s
        roots = belief[: t.levels[1]] if len(t.levels) > 1 else belief
        z = np.logaddexp(roots[:, 0], roots[:, 1]).sum()
        norm = np.logaddexp(belief[:, 0], belief[:, 1])
        marginal = np.exp(belief - norm[:, None])
        first = t.levels[1] if len(t.levels) > 1 else len(edge)
        edge[first:] = np.exp(edge[first:] - norm[first:, None, None])
        return marginal, edge, float(z)

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """The probability of being content of each page's elements."""
        t = Trees(pages)
        p = self.sums(t)[0][:, 1][t.place]
        return [p[a:b] for a, b in zip(t.starts[:-1], t.starts[1:], strict=True)]


def fitted(pages: list[Page], labels: list[list[int]], *, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by Adam; the gradient is what is seen less what the marginals expect."""
    t = Trees(pages)
    y = np.concatenate([np.array(x) for x in labels])[t.order]
    first = t.levels[1]
    seen, seen_pair = np.zeros((FEATURES, 2)), np.zeros((EDGES, 2, 2))
    for v in (0, 1):
        seen[:, v] = t.x[y == v].sum(0)
    np.add.at(seen_pair, (t.kind[first:], y[t.parent[first:]], y[first:]), 1)
    w = [np.zeros((FEATURES, 2)), np.zeros((EDGES, 2, 2))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        marginal, edge, _ = Model(*w).sums(t)
        expected = (t.x[first:, :EDGES].T @ edge[first:].reshape(-1, 4).astype(np.float32)).reshape(EDGES, 2, 2)
        for k, g in enumerate((t.x.T @ marginal.astype(np.float32) - seen, expected - seen_pair)):
            g = g / len(pages) + ridge * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(w[0].astype(np.float32), w[1])


_PROSE = "A plain sentence of the article that runs on for a while, as sentences of articles do, before it comes to its end."
#: Pages labelled by hand: what stands between <article> and its end or in class x-in is content, but for OUTSIDE and class x-out.
LABELLED = [
    f"<body class=x-in><p>{_PROSE}</p><p>{_PROSE}</p></body>",
    f"<body><h1 class=x-in>Title</h1><p class=x-in>{_PROSE} {_PROSE} {_PROSE} {_PROSE}</p><p class=x-in>{_PROSE} {_PROSE}</p></body>",
    f"<body><nav><a href=a>One</a> <a href=b>Two</a></nav><h1 class=x-in>Title</h1><p class=x-in>{_PROSE} {_PROSE}</p><p class=x-in>{_PROSE}</p><footer><p>All rights reserved.</p></footer></body>",
    f"<body><header><div class=logo>Site</div><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav></header><article><header><h1>Title</h1></header><p>{_PROSE}</p><p>Short.</p><blockquote>{_PROSE}</blockquote><ul><li>One thing</li><li>{_PROSE}</li></ul><aside><p>{_PROSE}</p></aside></article><aside class=sidebar><h3>More</h3><ul><li><a href=c>Three</a></li></ul><p>{_PROSE}</p></aside><footer><p>All rights reserved by the site.</p></footer></body>",
    f"<body><div class='cookie notice'><p>{_PROSE}</p></div><div id=menu class=menu><a href=a>One</a> <a href=b>Two</a></div><article><h1>Title</h1><p>{_PROSE}</p><h2>Part</h2><p>{_PROSE}</p><pre>x = 1</pre><div class='ad x-out'><p>{_PROSE}</p></div><p>Last words.</p><div class='share social x-out'><a href=s>Share</a></div></article><div id=comments class=comments><h3>Comments</h3><div class=comment><p>{_PROSE}</p></div><div class=comment><p>Agreed.</p></div></div><form class=form><p>{_PROSE}</p></form><div class=footer><p>{_PROSE}</p></div></body>",
    f"<body><div class=header><p>Name of the site</p></div><div class=sidebar><p>{_PROSE}</p><ul><li>{_PROSE}</li></ul></div><article><h1>Title</h1><h2>{_PROSE}</h2><div><p>{_PROSE}</p><p>{_PROSE}</p></div><table><tr><td>1</td><td>{_PROSE}</td></tr></table><section class='comments x-out'><h2>Replies</h2><p>{_PROSE}</p></section></article><div class='newsletter subscribe'><p>{_PROSE}</p></div><div class='related'><h3>Related</h3><p>{_PROSE}</p></div><div class='banner promo'>{_PROSE}</div></body>",
    f"<body><div class=nav>Home Shop</div><div class=advert>{_PROSE}</div><article><h1>Title</h1>{_PROSE}<figure><figcaption>A picture</figcaption></figure><p>{_PROSE}</p><dl><dt>Word</dt><dd>{_PROSE}</dd></dl></article><div class=ads>Buy.</div><div class=popup><p>Sign up now</p></div></body>",
]


def drawn_pages(n: int, seed: int = 6) -> list[str]:
    """`n` labelled pages drawn by rule, marked as LABELLED: articles told by element, by class or not at all, in bodies,
    nested divisions or loose text, short and long, with clutter told by element or class before, within and after them."""
    rng = random.Random(seed)
    lengths = (6, 15, 40, 80, 135, 250, 600, 1500)

    def prose(at_least: int = 0) -> str:
        size, out = rng.choice([x for x in lengths if x >= at_least]), ""
        while len(out) < size:
            out += "w" * rng.randint(2, 9) + rng.choice((" ", " ", " ", ", ", ". "))
        return out.strip() if rng.random() < 0.8 else out + "<a href=l>" + "k" * rng.randint(3, 12) + "</a> " + "w" * rng.randint(3, 30)

    def links() -> str:
        return "<ul>" + "".join(f"<li><a href=l>{'k' * rng.randint(3, 25)}</a></li>" for _ in range(rng.randint(1, 8))) + "</ul>"

    def part() -> str:
        kind = rng.choice(("p", "p", "p", "p", "p", "p", "h2", "h3", "ul", "ol", "blockquote", "pre", "table", "figure", "dl", "div", "section", "deep", "span"))
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{prose()}</li>" for _ in range(rng.randint(1, 5))) + f"</{kind}>"
        inner = {"table": f"<tr><td>{prose()}</td><td>{prose()}</td></tr><tr><th>a</th><td>{prose()}</td></tr>", "figure": f"<figcaption>{prose()}</figcaption>", "dl": f"<dt>{prose()}</dt><dd>{prose()}</dd>", "section": f"<h2>{prose()}</h2><p>{prose()}</p>", "span": f"<span class=lead>{prose()}</span>", "blockquote": f"<p>{prose()}</p>"}
        if kind == "deep":
            depth = rng.randint(1, 9)
            return "<div>" * depth + f"<p>{prose()}</p>" + "</div>" * depth
        tag = "p" if kind == "span" else kind
        return f"<{tag}>{inner.get(kind) or prose()}</{tag}>"

    def clutter(*, within: bool) -> str:
        inner = rng.choice((prose(), f"<p>{prose()}</p>", f"<h3>{prose()}</h3><p>{prose()}</p>", links(), f"<h2>{prose()}</h2>{links()}", f"<div><p>{prose()}</p><p>{prose()}</p></div>", f"<ol><li><p>{prose()}</p></li><li><div>{prose()}</div></li></ol>"))
        if rng.random() < 0.08:
            word = rng.choice(REMARKS)
            return f"<section id='{word} x-out'>" + f"<article class={word}>{inner}</article>" * rng.randint(1, 3) + "</section>"
        if rng.random() < 0.45:
            tag = rng.choice(sorted(OUTSIDE - {"address"} if within else OUTSIDE | {"header"}))
            if tag == "header":
                inner = rng.choice((f"<h1>{prose()}</h1>", f"<div>{prose()}</div>{links()}", inner))
            return f"<{tag} class=x-out>{inner}</{tag}>"
        tag, word = rng.choice(("div", "div", "div", "section", "ul", "ol", "p", "aside", "article")), rng.choice(CLUTTER)
        if tag in ("ul", "ol"):
            inner = "".join(f"<li>{rng.choice((prose(), f'<p>{prose()}</p>'))}</li>" for _ in range(rng.randint(1, 4)))
        if tag == "p":
            inner = prose()
        if tag == "article" and word not in REMARKS:
            tag = "div"
        return f"<{tag} {rng.choice(('class', 'id'))}='{word} x-out'>{inner}</{tag}>"

    def site() -> str:
        return clutter(within=False) if rng.random() < 0.6 else f"<header class=x-out>{rng.choice((f'<h1>{prose()}</h1>', f'<p>{prose()}</p>'))}</header>" if rng.random() < 0.5 else ""

    def some(most: int, *, within: bool = False) -> str:
        return "".join(clutter(within=within) for _ in range(rng.randint(0, most)))

    out = []
    for i in range(n):
        parts = [part() for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(1, len(parts)), some(2, within=True))
        title = f"<h1>{prose()}</h1>" if rng.random() < 0.8 else ""
        text = title + "".join(parts)
        match i % 6:
            case 0:  # no marks, no clutter to speak of
                if rng.random() < 0.3:  # nor a body
                    out.append("".join(f"<p class=x-in>{prose()}</p>" for _ in range(rng.randint(1, 4))))
                else:
                    out.append(f"<body class=x-in>{rng.choice((text, text, ''.join(parts), part(), title + part()))}{some(1)}</body>")
            case 1:  # loose text
                out.append(prose() if i % 4 == 1 else f"{prose(40)}{text}")
            case 2 | 3:
                tag = rng.choice(("article", "article", "main"))
                head = f"<header>{title}{rng.choice(("", f"<p>{prose()}</p>"))}</header>" if rng.random() < 0.4 else title
                wrap = "<div>" * rng.randint(0, 3)
                out.append(f"<body>{site()}{some(3)}{wrap}<{tag}>{head}{''.join(parts)}</{tag}>{wrap.replace('<', '</')}{some(4)}</body>")
            case 4:  # told by class
                word = rng.choice(("content", "entry", "post", "story", "articleBody", "main", "text"))
                out.append(f"<body class=x-in>{site()}{some(2)}<div {rng.choice(('class', 'id'))}={word}>{text}</div>{some(3)}</body>")
            case _:  # nested divisions
                depth, tag = rng.choice((1, 1, 2, 3, 6, 12, 40)), rng.choice(("div", "div", "section"))
                out.append(f"<body class=x-in>{site()}{some(2)}{f'<{tag}>' * depth}{text}{f'</{tag}>' * depth}{some(3)}</body>")
    return [*out, *(f"<body>{clutter(within=False)}{clutter(within=False)}</body>" for _ in range(n // 12))]


def labels_of(page: Page) -> list[int]:
    """Labels from the page's own marks: inside article or main, and not in what is never content.

    Where no element is marked, elements around content are content too, and so is a page that starts as loose text.
    """
    marked = any(t in MARKS and "out" not in w for t, w in zip(page.tag, page.words, strict=True))
    inside, out = [not marked and any(owner == 0 and piece.strip() for owner, _, piece in page.texts)], [False]
    for i in range(1, len(page.parent)):
        p, tag, words = page.parent[i], page.tag[i], page.words[i]
        inside.append(inside[p] or (tag in MARKS) or ("x" in words and "in" in words))
        out.append(out[p] or tag in OUTSIDE or told_outside(tag, known_words(words)) or ("x" in words and "out" in words))
    label = [int(a and not b) for a, b in zip(inside, out, strict=True)]
    return label if marked else around(page, label)


def around(page: Page, label: list[int]) -> list[int]:
    """The labels with elements around content as content."""
    label = list(label)
    for i in range(len(label) - 1, 0, -1):
        label[page.parent[i]] |= label[i]
    return label


def learned(sources: list[str]) -> Model:
    """Fit on labelled pages: those drawn by rule, those of this module and the given; pages whose article is marked
    also with their article told as a plain division or by class.

    The second and third view teach what articles look like where no page says so.
    """
    pages, labels = [], []
    for source in [*drawn_pages(DRAWN), *LABELLED * 2, *sources]:
        for view in ("", "div", "div class=content"):
            given = parsed(source)
            known = labels_of(given)
            if view:
                if not any(t in MARKS for t in given.tag):
                    break
                words = ["content"] if view != "div" else []
                given.words = [words if t in MARKS and "out" not in w else w for t, w in zip(given.tag, given.words, strict=True)]
                given.tag = ["div" if t in MARKS else t for t in given.tag]
                known = around(given, known)
            given.words = [[w for w in ws if w not in ("x", "in", "out")] for ws in given.words]
            pages.append(given)
            labels.append(known)
    return fitted(pages, labels)


def fit_model(pages: DataFrame, *, sample: int = SAMPLE, longest: int = LONGEST, source: str = "html") -> Model:
    """Fit on at most `sample` pages of at most `longest` characters that mark their article, the first by hash."""
    marked = only(pages, html=source).filter(F.length("html") <= longest).filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    rows = marked.distinct().orderBy(F.xxhash64("html"), "html").limit(sample).toArrow().column("html").to_pylist()
    return learned(sorted(rows))


def main_text(page: Page, content: np.ndarray) -> str:
    """Texts of the elements that are content; white space in a block becomes one space, blocks are lines."""
    blocks: dict[int, list[str]] = {}
    for owner, block, piece in page.texts:
        if content[owner] >= 0.5:
            blocks.setdefault(block, []).append(piece)
    lines = (" ".join("".join(pieces).split()) for pieces in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, *, model: Model | None = None, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every whole page.

    Elements are nodes of a tree-structured model; sum-product messages up and down give each its
    probability of being content. Scripts, styles, drawings, buttons and other controls inside a line
    don't end it. Null, empty and contentless pages give an empty text; whole pages are read, however
    long or deep; a page without tags is content. Rows are independent: null or repeated ids stay as many rows. An empty table gives no rows (the model then
    rests on this module's labelled pages). Other columns are ignored. Nothing is shuffled but the
    bounded sample of labelled pages; the model's arrays, of fixed size, go along with the tasks.
    """
    model = fit_model(pages, source=source) if model is None else model
    given = only(pages, page_id=page_id, url=url, html=source)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [parsed(s or "") for s in batch.column(2).to_pylist()]
        texts = [main_text(p, c) for p, c in zip(read, model.content(read), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in given.schema}
    return map_arrow(given, run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long", 256)
