"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each text block is a node whose hidden state is content or not. A node's evidence is a
logistic model over its tag, class and id words, link share, length and punctuation; an edge's potential
is the probability of a child's state given its parent's, by the kind of child (element or block). Sum-
product messages go upward from the leaves and downward from the root, and a block is main text where its
marginal is at least one half. Both parts are trained from labelled pages: ``labelled_pages`` writes pages
of many layouts (semantic elements or plain divisions, with menus, notices, adverts, forms, comments beside
and within the main part, linked sources, pages of one block) whose content is known. Training is
deterministic, takes a few seconds on the driver and is done once in a process.

What isn't text never becomes a node: scripts, styles, templates, comments, the head, form controls.
Character references are decoded, white space in a block is one blank, blocks join by a blank.

Cases: null and empty pages have the empty text; broken markup is read leniently (open elements end with
the page, stray end tags are ignored); repeated rows are extracted each; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

#: Places of hashed evidence; few enough words are trained that no two of them meet.
WIDTH = 1 << 14
PAGES = 800
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

#: HTML elements by kind, fixed values of the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template noscript head title svg math iframe object canvas audio video select textarea button option datalist".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
CELLS = frozenset(("td", "th"))
SCOPES = frozenset("table ul ol dl menu article section main body html div td th".split())

_TAG = re.compile(r"""<(?:!--(?P<note>.*?)(?:-->|--!>|\Z)|(?P<decl>[!?][^>]*>?)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?P<open>>?))""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


#: Elements that hold a piece of text; the share of their evidence is fitted.
BLOCKS = frozenset("p li h2 h3 h4 h5 h6 pre blockquote td th tr table ul ol dl dt dd figcaption figure".split())


class Node:
    __slots__ = ("tag", "names", "parent", "children", "text", "chars", "link_chars", "is_link", "truth", "place", "of_page")

    def __init__(self, tag: str, parent, names=()):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[Node] = []
        self.text = None  # of a block
        self.chars = self.link_chars = 0
        self.is_link = tag == "a" or (parent is not None and parent.is_link)
        self.truth = None
        self.place = 0
        self.of_page = 0.0  # share of the page's text


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; blocks have ``text``. Inline elements are no nodes."""
    root = Node("html", None)
    nodes, stack = [root], [root]  # open elements; inline ones are put as tag strings in between
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by tag
    inline: Counter[str] = Counter()
    parts: list[str] = []
    link = 0
    drop, at = None, 0
    last_head = None

    def close_block():
        nonlocal parts, link
        text = " ".join("".join(parts).split())
        if text:
            n = Node("#", stack[-1])
            n.text, n.chars, n.link_chars = text, len(text), min(link, len(text))
            stack[-1].children.append(n)
            nodes.append(n)
        parts, link = [], 0

    def add(raw: str):
        nonlocal link
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if inline["a"]:
                link += len(raw.strip())

    def pop_to(i: int):
        close_block()
        for n in stack[i:]:
            places[n.tag].pop()
        del stack[i:]
        inline.clear()

    def top(tags) -> int:
        """Place of the innermost open element with one of the tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m["name"] is not None and not m["open"]:  # a tag that the page's end cuts off
            if drop is None:
                add(page[at : m.start()])
            at = len(page)
            break
        if drop is None:
            add(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if drop is not None:
            if m["end"] and tag == drop:
                drop = None
            continue
        if m["end"]:
            if tag in INLINE:
                inline[tag] -= inline[tag] > 0
            elif places[tag]:
                pop_to(places[tag][-1])
            elif tag in ("br", "p"):
                close_block()
            continue
        if tag in RAW or tag in DROPPED:
            close_block() if tag not in ("button", "select") else None
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not m[0].endswith("/>"):
                drop = tag
                if tag == "head":  # a head without end: its elements are dropped one by one
                    last_head = page.lower().rfind("</head") if last_head is None else last_head
                    drop = drop if last_head >= at else None
            continue
        if tag == "br" or tag in VOID:
            if tag in ("br", "hr"):
                close_block()
            continue
        if tag in INLINE:
            inline[tag] += 1
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            i = top(("p",))
            if i > top(("td", "th", "table")):
                pop_to(i)
        if tag in CLOSED_BY:
            i = top(CLOSED_BY[tag])
            if i and i >= top(SCOPES - CELLS if tag in ("tr", "tbody", "tfoot", "thead") else SCOPES):
                pop_to(i)
        close_block()
        names = []
        if m["attrs"]:
            for a in _ATTR.finditer(m["attrs"]):
                names += [w.lower() for w in _HUMP.split(a[2] or a[3] or a[4] or "") if w]
        n = Node(tag, stack[-1], tuple(names))
        stack[-1].children.append(n)
        nodes.append(n)
        places[tag].append(len(stack))
        stack.append(n)
    if drop is None and at < len(page):
        add(page[at:])
    close_block()
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
    for n in nodes:
        n.of_page = n.chars / max(1, root.chars)
    return nodes


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % (WIDTH - 16) + 16


_SLOTS: dict[str, int] = {}


def features(n: Node) -> list[tuple[int, float]]:
    """(place, value) of a node's evidence."""

    def slot(w):
        if w not in _SLOTS:
            if len(_SLOTS) > 20_000:
                _SLOTS.clear()
            _SLOTS[w] = _slot(w)
        return _SLOTS[w]

    share = n.link_chars / n.chars if n.chars else 0.0
    out = [(0, 1.0), (1, share)]
    if n.text is not None:
        out += [(3, 1.0), (slot("under:" + n.parent.tag), 1.0), (4, float(n.text[-1] in ".!?…\"”'»")), (5, min(1.0, n.text.count(",") / 5)), (2, min(6.0, float(np.log1p(n.chars))) / 6), (8, n.of_page), (10, float(n.of_page > 0.9))]
        if n.text.startswith(("©", "Copyright", "(c)")):
            out.append((7, 1.0))
    else:
        out += [(slot("tag:" + n.tag), 1.0), (slot(f"pair:{n.parent.tag if n.parent is not None else ''} {n.tag}"), 1.0), (9, float(n.chars == 0)), (6, n.of_page)]
        out += [(slot("name:" + w), 1.0) for w in set(n.names)]
    return out


class Model:
    """Evidence weights, prior of a node's state, and P(child is content | parent's state) by kind."""

    def __init__(self, weights: np.ndarray, prior: float, root: float, edge: dict, share: float = 1.0):
        self.weights, self.prior, self.root, self.edge, self.share = weights.tolist(), prior, root, edge, share

    def _edge(self, n: Node) -> tuple[float, float]:
        """P(content) under a parent that isn't and one that is; the root has edges of its own where they are trained."""
        kind = n.text is not None
        return self.edge["root", kind] if n.parent.parent is None and ("root", kind) in self.edge else self.edge[kind]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by one pass upward and one downward."""
        for i, n in enumerate(nodes):
            n.place = i
        w, k = self.weights, len(nodes)
        same = Counter(n.text for n in nodes if n.text is not None)
        lift = []  # evidence ratio content : not
        for n in nodes:
            z = sum(w[p] * v for p, v in features(n)) - self.prior if n.parent is not None else 0.0
            near_root = n.parent is None or n.parent.parent is None or (n.text is not None and n.parent.parent.parent is None and len(n.parent.children) == 1)
            if (n.text is not None or n.tag in BLOCKS) and not near_root:  # nothing speaks through the root
                t = n.text if n.text is not None else n.children[0].text if len(n.children) == 1 else None
                z *= (self.share if n.text is not None else min(1.0, 2 * self.share)) / same.get(t, 1)  # repeats vote once, and neighbouring blocks say much the same: each has a share of a vote
            lift.append(float(np.exp(max(-12.0, min(12.0, z)))))
        up = [(1.0, 1.0)] * k  # message to the parent, for its states (not, content)
        own = [(1.0, float(x)) for x in lift]  # evidence times the children's messages
        for i in range(k - 1, 0, -1):
            a, b = own[i]
            s = a + b
            e0, e1 = self._edge(nodes[i])
            msg = ((1 - e0) * a + e0 * b) / s, ((1 - e1) * a + e1 * b) / s
            up[i] = msg
            p = nodes[i].parent.place
            x, y = own[p][0] * msg[0], own[p][1] * msg[1]
            t = x + y
            own[p] = (x / t, y / t)
        out, down = [0.0] * k, [(1 - self.root, self.root)] * k
        for i, n in enumerate(nodes):
            if i:
                p = n.parent.place
                # the parent's belief without this child's message
                x, y = down[p][0] * own[p][0] / up[i][0], down[p][1] * own[p][1] / up[i][1]
                t = x + y
                x, y = x / t, y / t
                e0, e1 = self._edge(n)
                d1 = x * e0 + y * e1
                down[i] = (1 - d1, d1)
            a, b = down[i][0] * own[i][0], down[i][1] * own[i][1]
            out[i] = b / (a + b)
        return out

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        p = self.marginals(nodes)
        return " ".join(n.text for n, x in zip(nodes, p) if n.text is not None and x >= 0.5)


_SYLLABLES = "ba co di fe gu ha jo ki lu ma ne po ra si tu va wo ze chi tre sta plo".split()
#: Words that layouts use for class and id names, by part of a page; fixed values.
NAMES = {
    "main": "content article post entry main story body text page single hentry prose blog detail document".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav submenu tabs pagination pager toc skip".split(),
    "header": "header masthead topbar banner branding logo sitehead".split(),
    "footer": "footer copyright colophon bottom legal credits sitefoot imprint".split(),
    "side": "sidebar aside widget rail related recommended popular trending recent tags archive secondary teaser more promoted".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp banner commercial".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay banner message privacy warning announcement toast".split(),
    "comment": "comment comments reply replies respond discussion disqus reader responses commentlist thread".split(),
    "form": "form newsletter subscribe signup login search contact subscription register".split(),
    "share": "share social sharing follow buttons toolbar actions byline meta author".split(),
}


def labelled_pages(count: int = PAGES, seed: int = 5) -> list[list[Node]]:
    """Parsed pages of many layouts with ``truth`` set on every node.

    Main text is written with a mark character before each block's words, which parsing keeps and training
    removes, so a block's label comes from the page itself.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3))))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 16).capitalize() + r.choice((", " + words(2, 8), "", "")) + r.choice("....!?")
    mark = "\x01"

    def named(part: str, tags: tuple[str, ...], inner: str) -> str:
        tag = r.choice(tags)
        names = NAMES[part]
        attr = ""
        if tag in ("div", "section", "ul", "p") or r.random() < 0.3:
            attr = f' {r.choice(("class", "id"))}="{" ".join(r.sample(names, r.choice((1, 1, 2))))}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        if r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"
        return " ".join(f'<a href="/x">{words(1, 3)}</a>' for _ in range(r.randint(a, b)))

    def plain(a: int, b: int) -> str:
        return "".join(f"<p>{' '.join(sentence() for _ in range(r.randint(1, 3)))}</p>" for _ in range(r.randint(a, b)))

    def paragraph() -> str:
        n = r.choice((1, 1, 2, 3, 5, 9))
        odd = r.random()  # single words, lists without stops, one word over and over
        body = " ".join(sentence() for _ in range(n)) if odd < 0.6 else words(1, 3) + r.choice((".", "")) if odd < 0.8 else " | ".join(word() for _ in range(r.randint(2, 30))) if odd < 0.92 else " ".join([word()] * r.randint(3, 60))
        if r.random() < 0.2:
            i = body.find(" ", len(body) // 2)
            body = body[:i] + f' <a href="/y">{words(1, 3)}</a>' + body[i:] if i > 0 else body
        kind = r.random()
        if r.random() < 0.15:  # links are text as well where an article has them
            odd = r.random()
            if odd < 0.35:
                return f'<p><a href="/y">{mark}{words(2, 8).capitalize()}</a></p>'
            if odd < 0.6:
                return f"<h2>{mark}{words(1, 3)}</h2><ul>" + "".join(f'<li><a href="/y">{mark}{words(2, 7).capitalize()}</a></li>' for _ in range(r.randint(1, 5))) + "</ul>"
            if odd < 0.75:
                return r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f'<li><a href="/y">{mark}{words(1, 6)}</a>{r.choice(("", ", " + words(1, 3)))}</li>' for _ in range(r.randint(1, 6))))
            return f'<p>{mark}{words(1, 3).capitalize()} <a href="/y">{words(3, 8)}</a> {words(1, 2)} <a href="/z">{words(2, 6)}</a>{r.choice((".", ""))}</p>'
        if kind < 0.08:
            return f"<blockquote>{mark}{body}</blockquote>"
        if kind < 0.16:
            return r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{mark}{sentence()}</li>" for _ in range(r.randint(2, 6))))
        if kind < 0.24:
            return f"<h2>{mark}{words(1, 7)}</h2><p>{mark}{body}</p>"
        if kind < 0.28:
            return f"<pre>{mark}{words(4, 20)}</pre>"
        if kind < 0.32:
            return "<table>" + "".join(f"<tr><td>{mark}{words(1, 3)}</td><td>{mark}{words(1, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind < 0.36:
            return f"<figure><figcaption>{mark}{sentence()}</figcaption></figure>"
        if kind < 0.42:
            return f"<p><b>{mark}{sentence()}<br>"
        return f"<p>{mark}{body}</p>"

    def form() -> str:
        label = f"<label>{words(1, 2).capitalize()}</label><input>"
        return r.choice((f"{words(2, 6)} <input> <button>{word()}</button>", label, label * 2, f"<p>{sentence()}</p>{label}<button>{word()}</button>", f"<p>{sentence()}</p>", f"<h3>{words(1, 4)}</h3><p>{sentence()}</p><form>{label}</form>"))

    def comments() -> str:
        one = lambda tags: named("comment", tags, r.choice((f"<p>{word()}</p>" + plain(1, 3), plain(1, 2), sentence())))
        if r.random() < 0.4:  # side by side, without a frame
            return "".join(one(("article", "section", "div")) for _ in range(r.randint(1, 3)))
        return named("comment", ("div", "section", "ol"), r.choice((f"<h3>{words(1, 3)}</h3>", "")) + "".join(one(("article", "div", "div") if r.random() < 0.4 else ("div", "li")) for _ in range(r.randint(1, 4))))

    def bare() -> str:
        """A page that is text alone, in one block or a few."""
        text = lambda: f"{mark}{' '.join(sentence() for _ in range(r.randint(1, 4)))}" if r.random() < 0.7 else f"{mark}{words(1, 6)}"
        inner = r.choice((text, lambda: "".join(f"<p>{text()}</p>" for _ in range(r.randint(1, 3))), lambda: "<br>".join(text() for _ in range(r.randint(2, 3)))))()
        for _ in range(r.choice((0, 1, 1, 1, 2))):
            inner = f"<div>{inner}</div>"
        return inner

    pages = []
    for i in range(count):
        if i % 8 == 7:
            pages.append(_labelled(r.choice(("{}", "<html><body>{}</body></html>")).format(bare()), mark))
            continue
        inside = [paragraph() for _ in range(r.choice((0, 1, 1, 2, 4, 8, 14)))] or [f"<p>{mark}{words(1, 4)}.</p>"]
        for part, chance in (("ad", 0.2), ("share", 0.25), ("side", 0.12), ("form", 0.2), ("notice", 0.05)):
            if r.random() < chance:
                inside.insert(r.randint(0, len(inside)), named(part, ("div", "aside", "div") if part != "form" else ("form", "div", "section"), plain(1, 2) if part in ("ad", "notice") else links(2, 5) if part != "form" else form()))
        if r.random() < 0.25:  # readers' comments within the main part
            inside.append(comments())
        title = f"<h1>{mark}{words(3, 10)}</h1>" if r.random() < 0.85 else ""
        main = title + "".join(inside)
        style = r.random()
        if style < 0.4:
            main = f"<article>{main}</article>"
        elif style < 0.53:
            main = f"<main>{main}</main>"
        elif style < 0.62:
            main = f"<main><article>{main}</article>{comments() if r.random() < 0.4 else ''}</main>"
        elif style < 0.82:
            main = named("main", ("div", "section"), main)
        elif style < 0.88:
            main = f"<div>{main}</div>"
        if r.random() < 0.3 and style < 0.88:  # else no container
            main = named("main", ("div",), main)
        if r.random() < 0.15:  # nothing but the text
            pages.append(_labelled(f"<html><body>{main}</body></html>" if r.random() < 0.5 else main, mark))
            continue
        before, after = [], []
        if r.random() < 0.8:
            before.append(named("nav", ("nav", "div", "ul"), links(3, 9)))
        if r.random() < 0.5:
            before.append(named("header", ("header", "div"), r.choice((f"<h2>{words(1, 4)}</h2>", f"<h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>", links(3, 6)))))
        if r.random() < 0.4:
            tag = r.choice(("div", "section", "p"))
            (before if r.random() < 0.5 else after).append(named("notice", (tag,), (sentence() if tag == "p" else plain(1, 2)) + r.choice(("", "<button>ok</button>"))))
        for part, chance in (("ad", 0.6), ("side", 0.5), ("form", 0.3)):
            if r.random() < chance:
                tags = {"ad": ("div", "div", "aside", "section"), "side": ("aside", "div", "section"), "form": ("form", "div")}[part]
                inner = {"ad": r.choice((plain(1, 2), sentence(), links(1, 3))), "side": r.choice((links(3, 8), f"<h3>{words(1, 3)}</h3>" + links(3, 8), plain(1, 4))), "form": f"<p>{sentence()}</p><label>{word()}</label><input><button>{word()}</button>"}[part]
                (before if r.random() < 0.5 else after).append(named(part, tags, inner))
        if r.random() < 0.4:
            after.append(comments())
        if r.random() < 0.85:
            after.append(named("footer", ("footer", "div"), r.choice((f"&copy; {words(1, 3)} &middot; {sentence()}", links(3, 7), f"<p>&copy; {words(2, 9)}</p>" + links(2, 5), plain(1, 2)))))
        r.shuffle(before)
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            body = f'<div{r.choice(("", ' id="wrapper"', ' class="container"'))}>{body}</div>'
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{body}" + r.choice(("</body></html>", "</body></html>", ""))
        pages.append(_labelled(page, mark))
    return pages


def _labelled(page: str, mark: str) -> list[Node]:
    """The page's nodes with ``truth``: of a block whether it has the mark, which goes; of an element by its children."""
    nodes = parse(page)
    for n in nodes:
        if n.text is not None:
            n.truth = mark in n.text
            n.text = n.text.replace(mark, "")
    for n in nodes[::-1]:
        if n.text is None:
            leaves = [c.truth for c in n.children if c.truth is not None]
            n.truth = None if not leaves else sum(leaves) * 2 > len(leaves) or (any(leaves) and n.tag not in ("div", "html", "section"))
    return nodes


def train(pages: list[list[Node]] | None = None) -> Model:
    """Evidence by penalised logistic regression, edges by counts."""
    pages = labelled_pages() if pages is None else pages
    rows, labels, edges = [], [], {True: np.ones((2, 2)), False: np.ones((2, 2))}
    under_root = {True: np.ones(2), False: np.ones(2)}
    for nodes in pages:
        for n in nodes:
            if n.truth is None or n.parent is None:
                continue
            rows.append(features(n))
            labels.append(n.truth)
            if n.parent.parent is None:
                under_root[n.text is not None][int(n.truth)] += 1
            elif n.parent.truth is not None:
                edges[n.text is not None][int(n.parent.truth), int(n.truth)] += 1
    used = np.array(sorted({p for row in rows for p, _ in row}))
    at = {p: j for j, p in enumerate(used.tolist())}
    d, y, theta = np.zeros((len(rows), len(used))), np.array(labels, float), np.zeros(len(used))
    for i, row in enumerate(rows):
        for p, v in row:
            d[i, at[p]] += v
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(d @ theta, -30, 30)))
        grad = d.T @ (y - p) - 1.0 * theta
        hess = (d * (p * (1 - p))[:, None]).T @ d + np.eye(len(used))
        theta += np.linalg.solve(hess, grad)
    weights = np.zeros(WIDTH)
    weights[used] = theta
    prior = float(np.log(y.mean() / (1 - y.mean())))
    edge = {k: (float(e[0, 1] / e[0].sum()), float(e[1, 1] / e[1].sum())) for k, e in edges.items()}
    # the root's state is free: what stands right under it is content as often as such nodes are, whatever the root is
    edge |= {("root", k): (float(r[1] / r.sum()),) * 2 for k, r in under_root.items()}
    models = [Model(weights, prior, 0.5, edge, share) for share in (1.0, 0.5, 0.3, 0.2, 0.1)]
    held = labelled_pages(60, 77)
    return max(models, key=lambda m: _likelihood(m, held))


def _likelihood(model: Model, pages: list[list[Node]]) -> float:
    """Log likelihood of the blocks' labels under their marginals."""
    return sum(float(np.log(max(1e-6, p if n.truth else 1 - p))) for nodes in pages for n, p in zip(nodes, model.marginals(nodes)) if n.text is not None)


@cache
def trained() -> Model:
    """The model of the generator's pages, trained once in a process."""
    return train()


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    model = model or trained()

    def run(batches):
        for b in shared.slices(batches, "html"):
            out = [model.text(h) for h in b.column("html").to_pylist()]
            yield shared.batch_of(_OUT, {"page_id": b.column("page_id"), "url": b.column("url"), "text": out, "n_chars": [len(t) for t in out]})

    return shared.in_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")
