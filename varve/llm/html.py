"""Operator 9: main text of a page by a tree-structured graphical model.

A page is read into a tree of elements. Each element has a binary label, content or not. Its own potential
comes from its tag, the words of its class and id, how much text it holds and how much of that is links;
a parent and a child share a potential. Sum-product messages go up the tree and down again, which gives
every element its exact marginal. Weights are trained by gradient ascent on the likelihood of labelled
pages, with the same messages for the expectations; the labelled pages are made from a rule here, since
the tables have none. Text whose element is more likely content than not is kept.

Text blocks: block elements begin and end a block; <br> is white space. Character references are decoded,
white space becomes one space, and blocks are joined by one line end, empty ones left out.

Defined results: a null or empty page gives the empty text; a page that ends in the middle of a tag is
read up to the tag; repeated rows are read each; other columns pass by choice; no depth is too deep, and
the work grows in proportion to the page, whatever it holds.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.session import small_batches

# Fixed values of HTML: elements without an end tag, with raw text, and that begin and end a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr dialog menu center".split()
)
#: Ended by the start of the elements after the colon.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
P_SCOPE = {"table", "caption", "td", "th", "button"}
#: A quote begins a value only behind "=": elsewhere it is a sign like any other. Nothing is read twice.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(>|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Words of classes and ids, by what they usually mark.
MARKS = {
    "advert": "ad ads advert advertisement banner sponsor sponsored promo promoted",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager",
    "aside": "sidebar side aside related widget widgets recommended trending popular more",
    "edge": "header footer masthead colophon copyright legal top bottom logo",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe subscription signup gdpr overlay",
    "comment": "comment comments reply replies discussion disqus respond feedback",
    "share": "share sharing social follow tags meta byline",
    "body": "article content post entry story main text body",
}
MARK_OF = {w: k for k, ws in MARKS.items() for w in ws.split()}


class Node:
    __slots__ = ("classes", "holder", "link", "parent", "size", "tag")

    def __init__(self, tag: str, parent: int, classes: str, holder: int):
        """holder: the number of the block element that holds it, itself if it is one."""
        self.tag, self.parent, self.classes, self.size, self.link, self.holder = tag, parent, classes, 0, 0, holder


class Stack:
    """Open elements, with the places of each tag: what is open and where is known without a search."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.open, self.at, self.blocks = nodes, [0], {}, [0]

    def push(self, node: int) -> None:
        tag = self.nodes[node].tag
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.nodes[self.open.pop()].tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """Where the innermost open element of a tag is; 0 if there is none."""
        found = self.at.get(tag)
        return found[-1] if found else 0

    def end(self, tag: str, scope: set[str]) -> None:
        """Close the innermost open tag, unless an element of scope is nearer."""
        place = self.last(tag)
        if place and place > max(map(self.last, scope), default=0):
            self.cut(place)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes in page order, pieces). A piece is (node, text) or, between blocks, (-1, '')."""
    nodes, pieces = [Node("#page", -1, "", 0)], []
    stack = Stack(nodes)
    at, low = 0, None
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            # a lone "<" is text; a tag that the page's end cuts is not
            pieces.append((stack.open[-1], page[at:]))
            break
        if m.start() > at:
            pieces.append((stack.open[-1], page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            break
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                pieces.append((-1, ""))
            place = stack.last(tag)
            # the end of an inline element doesn't end the block around it
            if place and (tag in BLOCK or place > stack.blocks[-1]):
                stack.cut(place)
            continue
        if tag in BLOCK:
            pieces.append((-1, ""))
            stack.end("p", P_SCOPE)
        if tag in ENDS or tag in SCOPES:
            for other in (t for t, by in ENDS.items() if tag in by):
                stack.end(other, SCOPES[other])
        if tag == "br":
            pieces.append((stack.open[-1], " "))
        if tag in VOID:
            continue
        named = NAMED.findall(m[3]) if m[3] else ()
        parent = stack.open[-1]
        holder = len(nodes) if tag in BLOCK or tag in ("button", "label", "select", "option") or not parent else nodes[parent].holder
        nodes.append(Node(tag, parent, " ".join(a or b or c for a, b, c in named).lower(), holder))
        if tag in RAW:
            low = page.lower() if low is None and len(page.lower()) == len(page) else low
            close = (low or page).find(f"</{tag}", at)
            at = len(page) if close < 0 else close
            if close >= 0 and (e := page.find(">", close)) >= 0:
                at = e + 1
            elif close >= 0:
                at = len(page)
            continue
        if not m[3].endswith("/") or tag in BLOCK:
            stack.push(len(nodes) - 1)
    return nodes, pieces


def measure(nodes: list[Node], pieces: list[tuple[int, str]]) -> None:
    """Size of all text and of link text below each node."""
    linked = [False] * len(nodes)
    for i, n in enumerate(nodes):
        linked[i] = n.tag in ("a", "button") or (n.parent >= 0 and linked[n.parent])
    for i, text in pieces:
        if i >= 0 and (size := len(text.strip())):
            nodes[i].size += size
            nodes[i].link += size * linked[i]
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].size += nodes[i].size
        nodes[nodes[i].parent].link += nodes[i].link


def key(n: Node) -> tuple[str, str, int, int]:
    size = 0 if not n.size else 1 + min(6, n.size.bit_length() // 2)
    return n.tag, n.classes, size, min(3, 4 * n.link // n.size) if n.size else 0


@lru_cache(maxsize=65536)
def features(k: tuple[str, str, int, int]) -> tuple[str, ...]:
    tag, classes, size, link = k
    marks = sorted({MARK_OF[w] for w in re.split(r"[^a-z]+", classes) if w in MARK_OF})
    # an element that says nothing of itself by class, id or role
    bare = (f"bare:{tag}", f"bare:{tag}:link:{link}") if not classes else ()
    return ("bias", f"tag:{tag}", f"size:{size}", f"link:{link}", *bare, *(f"mark:{x}" for x in marks))


class Model:
    """Weights of features for 'content', and the parent-child potential by (parent label, child label)."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]
        self._own: dict[tuple, float] = {}

    def own(self, n: Node) -> float:
        k = key(n)
        u = self._own.get(k)
        if u is None:
            if len(self._own) > 50_000:
                self._own.clear()
            u = self._own[k] = sum(self.w.get(f, 0.0) for f in features(k))
        return u

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of content for each node; log odds of it and of its parent without each other (for pairs)."""
        (p00, p01), (p10, p11) = [[math.exp(v) for v in row] for row in self.pair]
        up, below = [0.0] * len(nodes), [self.own(n) for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parent
            s = math.exp(max(-30.0, min(30.0, below[i])))
            up[i] = math.log((p11 * s + p10) / (p01 * s + p00))
            below[nodes[i].parent] += up[i]
        belief, above = below[:], [0.0] * len(nodes)
        for i in range(1, len(nodes)):
            above[i] = belief[nodes[i].parent] - up[i]
            t = math.exp(max(-30.0, min(30.0, above[i])))
            belief[i] = below[i] + math.log((p11 * t + p01) / (p10 * t + p00))
        return belief, below, above

    def learn(self, pages: list[tuple[list[Node], list[int]]], rounds: int = 80, rate: float = 0.3, decay: float = 0.01) -> None:
        for _ in range(rounds):
            grad: dict[str, float] = {}
            pair = [[0.0, 0.0], [0.0, 0.0]]
            self._own.clear()
            for nodes, labels in pages:
                belief, below, above = self.marginals(nodes)
                e = [[math.exp(v) for v in row] for row in self.pair]
                for i, n in enumerate(nodes):
                    miss = labels[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, belief[i]))))
                    for f in features(key(n)):
                        grad[f] = grad.get(f, 0.0) + miss
                    if i:
                        s, t = (math.exp(max(-30.0, min(30.0, v))) for v in (below[i], above[i]))
                        joint = [[e[0][0], e[0][1] * s], [e[1][0] * t, e[1][1] * s * t]]
                        z = sum(map(sum, joint))
                        for a in (0, 1):
                            for b in (0, 1):
                                pair[a][b] += (labels[n.parent] == a and labels[i] == b) - joint[a][b] / z
            for f, g in grad.items():
                self.w[f] = self.w.get(f, 0.0) * (1 - decay * rate) + rate * g / len(pages)
            for a in (0, 1):
                for b in (0, 1):
                    self.pair[a][b] = self.pair[a][b] * (1 - decay * rate) + rate * pair[a][b] / len(pages) / 4
        self._own.clear()


def labelled_pages(n: int = 180, seed: int = 9) -> list[tuple[str, str]]:
    """(page, main text) made by a rule: an article between the usual other parts, in several layouts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))
    out = []
    for k in range(n):
        title, blocks = say(2, 10), []
        if k % 15 == 14:  # plain text, in lines that are none to HTML, or little markup
            body = say(3, 120)
            out.append((rng.choice(["{}", "<html><body>{}</body></html>", "<p>{}</p>", "<div>{}</div>", "<body><div>{}</div></body>"]).format(body), body))
            continue
        plain = rng.random() < 0.12  # an article in divs that say nothing
        # one page in five is many short blocks: each by itself would say little
        many, short = rng.random() < 0.2, rng.random() < 0.5
        for _ in range(rng.randint(20, 90) if many else rng.randint(1, 9)):
            if many and short:
                blocks.append(("p", say(1, 4)))
                continue
            blocks.append((rng.choice(["p"] * 8 + ["h2", "h3", "blockquote", "pre", "li", "td", "figcaption"]), say(1, 12) if rng.random() < 0.3 else say(10, 90)))
        wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>", "figcaption": "<figure><figcaption>{}</figcaption></figure>"}
        body = ""
        for tag, text in blocks:
            inner = text if rng.random() < 0.7 else re.sub(r"^(\S+)", rng.choice([r"<b>\1</b>", r'<a href="/x">\1</a>', r"<em>\1</em>"]), text)
            body += wrap.get(tag, f"<{tag}>{{}}</{tag}>").format(inner)
        if plain:
            body = re.sub(r"(</?)(?:p|blockquote|pre)>", r"\1div>", body)
        main = (rng.choice(["<div>{}</div>", "{}", "<div><div>{}</div></div>"]) if plain else rng.choice(["<article>{}</article>"] * 3 + ["<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content"><article>{}</article></div>', "<main><article>{}</article></main>", '<section class="entry">{}</section>'])).format(f"<h1>{title}</h1>{body}")
        extra = {
            "nav": f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>" if rng.random() < 0.7 else f'<div class="menu"><ul>{links(5)}</ul></div>',
            "header": f'<header><a href="/">{word()}</a><p>{say(2, 6)}</p></header>',
            "ad": f'<div class="{rng.choice(["ad", "ads banner", "sponsored", "promo"])}">{say(2, 14)}</div>',
            "notice": f'<div class="{rng.choice(["cookie-notice", "consent", "newsletter", "popup"])}"><p>{say(5, 25)}</p><button>{word()}</button></div>',
            "aside": f'<aside><h3>{say(1, 3)}</h3><ul>{links(4)}</ul></aside>' if rng.random() < 0.5 else f'<div class="sidebar"><p>{say(4, 30)}</p></div>',
            "form": f"<form><label>{say(1, 3)}</label><input name=q><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>",
            "comments": f'<{(c := rng.choice(["section", "div"]))} class="comments"><h3>{word()}</h3>' + "".join(f'<div class="comment"><p>{say(5, 40)}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{c}>",
            "footer": f"<footer>&copy; {word()} &middot; {say(2, 14)}</footer>" if rng.random() < 0.7 else f'<div id="footer"><p>{say(3, 12)}</p></div>',
        }
        has = lambda k, p: extra[k] if rng.random() < p else ""
        page = f"<html><head><title>{title}</title><style>p{{}}</style><script>x('<p>')</script></head><body>"
        page += has("header", 0.4) + has("nav", 0.8) + has("notice", 0.3) + has("ad", 0.6) + main + has("ad", 0.3) + has("comments", 0.4) + has("aside", 0.4) + has("form", 0.3) + has("footer", 0.8) + "</body></html>"
        out.append((page, "\n".join([title, *(t for _, t in blocks)])))
    return out


def label(page: str, text: str) -> tuple[list[Node], list[int]]:
    """Nodes and labels: content are the elements all of whose text lies in the main text's blocks."""
    nodes, pieces = parse(page)
    measure(nodes, pieces)
    lines = set(text.split("\n"))
    good = [0] * len(nodes)
    for block in _blocks(pieces):
        if SPACE.sub(" ", _html.unescape("".join(t for _, t in block))).strip() in lines:
            for i, t in block:
                good[i] += len(t.strip())
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
    return nodes, [int(n.size > 0 and good[i] == n.size) for i, n in enumerate(nodes)]


def _blocks(pieces: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    now: list[tuple[int, str]] = []
    for p in pieces:
        if p[0] >= 0:
            now.append(p)
        elif now:
            yield now
            now = []
    if now:
        yield now


def train(n: int = 180) -> Model:
    model = Model()
    model.learn([label(*x) for x in labelled_pages(n)])
    return model


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, pieces = parse(page)
    measure(nodes, pieces)
    belief, _, _ = model.marginals(nodes)
    out = []
    for block in _blocks(pieces):
        kept = "".join(t for i, t in block if belief[nodes[i].holder] > 0)
        if line := SPACE.sub(" ", _html.unescape(kept)).strip(" "):
            out.append(line)
    return "\n".join(out)


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns and text, n_chars. The model is a few hundred numbers, trained on the driver unless given."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    fields = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                text = [main_text(x, m) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(*keep, F.col(html)).mapInArrow(run, f"{fields}, text string, n_chars long")
