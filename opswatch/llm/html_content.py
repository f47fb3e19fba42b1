"""Main-text extraction by a tree-structured graphical model.

Every element of a page is a node that is content or not. A node's own score comes from its tag, its class and id words
and its text; parent-child potentials tie neighbours in the tree. Sum-product messages, upward and then
downward, give exact marginals; text goes out with its nearest element if that is content with probability over
one half. Weights are fitted by the likelihood of labelled pages (``labelled_pages``: layouts of this module, whose
labels are known by construction) with gradients from the same messages.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: elements whose text is never shown as text
HIDDEN = frozenset("head script style template noscript title textarea select option button svg math iframe object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: an open element of the key is closed by a start tag of the value
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "marks", "parent", "chars", "link_chars", "stops")

    def __init__(self, tag: str, marks: str, parent: int) -> None:
        self.tag, self.marks, self.parent = tag, marks, parent
        self.chars = self.link_chars = self.stops = 0


class Tree(HTMLParser):
    """Nodes in page order (a parent before its children) and pieces of text: (node, shown in a block of, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", "", -1)]
        self.open = [0]
        self.blocks = 0
        self.pieces: list[tuple[int, int, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[depth]].tag
            if tag in CLOSED_BY.get(name, ()):
                del self.open[depth:]
                break
            if name not in INLINE and name not in CLOSED_BY:
                break
        if tag not in INLINE:
            self.blocks += 1
        if tag in VOID:
            return
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v)
        self.nodes.append(Node(tag, marks, self.open[-1]))
        self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and self.nodes[self.open[-1]].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.blocks += 1
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                del self.open[depth:]
                return
            if tag in INLINE and self.nodes[self.open[depth]].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not any(self.nodes[k].tag in HIDDEN for k in self.open):
            self.pieces.append((self.open[-1], self.blocks, data))


def parse(html: str | None) -> tuple[list[Node], list[tuple[int, int, str]]]:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    for node, _, text in tree.pieces:
        n = len(text.strip())
        if not n:
            continue
        stops = sum(text.count(c) for c in ".,;!?")
        linked = False
        while node >= 0:
            at = tree.nodes[node]
            linked = linked or at.tag == "a"
            at.chars += n
            at.link_chars += n if linked else 0
            at.stops += stops
            node = at.parent
    return tree.nodes, tree.pieces


def features(node: Node) -> list[str]:
    out = ["bias", "tag " + node.tag, f"size {min(int(math.log2(node.chars + 1)) // 2, 5)}"]
    links = node.link_chars / node.chars if node.chars else 0
    out.append("links " + ("none" if links == 0 else "few" if links < 0.4 else "most"))
    rate = node.stops / node.chars if node.chars else 0
    out.append("stops " + ("none" if rate == 0 else "few" if rate < 0.01 else "some"))
    out += ["mark " + w for w in set(WORD.findall(node.marks.lower()))]
    return out


#: pair states: (parent, child) as 2 * parent + child; an inline child has potentials of its own
def _pairs(node: Node) -> int:
    return 1 if node.tag in INLINE else 0


def marginals(nodes: list[Node], scores: list[float], ties: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """P(content) of every node, and for every node but the root the four joint probabilities with its parent."""
    n = len(nodes)
    up0, up1 = [0.0] * n, list(scores)
    sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for k in range(n - 1, 0, -1):  # children come after their parents
        t = ties[_pairs(nodes[k])]
        message = (_add(t[0] + up0[k], t[1] + up1[k]), _add(t[2] + up0[k], t[3] + up1[k]))
        sent[k] = message
        up0[nodes[k].parent] += message[0]
        up1[nodes[k].parent] += message[1]
    down0, down1 = [0.0] * n, [0.0] * n
    p, joint = [0.0] * n, [[0.0] * 4 for _ in range(n)]
    for k in range(n):
        if k:
            m = nodes[k].parent
            rest0, rest1 = down0[m] + up0[m] - sent[k][0], down1[m] + up1[m] - sent[k][1]
            t = ties[_pairs(nodes[k])]
            down0[k], down1[k] = _add(rest0 + t[0], rest1 + t[2]), _add(rest0 + t[1], rest1 + t[3])
            logs = [rest0 + t[0] + up0[k], rest0 + t[1] + up1[k], rest1 + t[2] + up0[k], rest1 + t[3] + up1[k]]
            top = max(logs)
            weights = [math.exp(x - top) for x in logs]
            total = sum(weights)
            joint[k] = [w / total for w in weights]
        p[k] = 1 / (1 + math.exp(min(max(down0[k] + up0[k] - down1[k] - up1[k], -500), 500)))
    return p, joint


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _text(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        word = "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))
        out.append(word.capitalize() if k == 0 else word)
        if rng.random() < 0.12:
            out[-1] += rng.choice(",.;")
    return " ".join(out) + rng.choice("..!?")


def labelled_pages(n: int = 200, seed: int = 5) -> list[str]:
    """Pages whose content elements carry ``itemprop="zz"``; the mark is read as the label and not as a feature."""
    rng = random.Random(seed)

    def menu() -> str:
        items = "".join(f"<li><a href=/x>{_text(rng, rng.randint(1, 2))[:-1]}</a></li>" for _ in range(rng.randint(3, 7)))
        mark = rng.choice(["", " class=menu", " class='nav links'", " id=menu"])
        return rng.choice([f"<nav{mark}><ul>{items}</ul></nav>", f"<div class='nav menu'><ul>{items}</ul></div>", f"<ul class=menu>{items}</ul>"])

    def beside() -> str:
        text, links = _text(rng, rng.randint(3, 30)), "".join(f"<li><a href=/y>{_text(rng, 3)}</a></li>" for _ in range(4))
        return rng.choice([
            f"<div class={rng.choice(['ad', 'ads', 'advert', 'advertisement', 'promo', 'sponsored', 'banner'])}>{text}</div>",
            f"<aside{rng.choice(['', ' class=sidebar', ' id=sidebar'])}><h3>{_text(rng, 2)}</h3><ul>{links}</ul><p>{text}</p></aside>",
            f"<div class={rng.choice(['sidebar', 'related', 'widget', 'recommended'])}><h2>{_text(rng, 2)}</h2><p>{text}</p><ul>{links}</ul></div>",
            f"<div class='{rng.choice(['cookie notice', 'notice', 'consent', 'popup', 'cookie banner', 'alert', 'subscribe newsletter'])}' role=dialog><p>{text}</p></div>",
            f"<form{rng.choice(['', ' class=search', ' class=newsletter', ' id=login'])}><label>{_text(rng, 2)}</label><p>{text}</p><input><button>Go</button></form>",
            f"<div class={rng.choice(['share', 'social', 'breadcrumb', 'tags', 'meta', 'byline'])}><a href=/s>{_text(rng, 1)}</a> <a href=/t>{_text(rng, 1)}</a></div>",
        ])

    def comments() -> str:
        said = "".join(
            f"<{t} class=comment><p><b>{_text(rng, 1)}</b> {_text(rng, rng.randint(4, 40))}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 4)
        )
        tag = rng.choice(["section", "div", "ol"])
        mark = rng.choice(["class=comments", "id=comments", "class='comment list'", "id=responses class=comments"])
        return f"<{tag} {mark}><h3>{_text(rng, 1)}</h3>{said}</{tag}>"

    def content() -> str:
        z, n = " itemprop=zz", rng.choice([3, 12, 40, 90])
        text = _text(rng, rng.randint(1, n))
        return rng.choice([f"<p{z}>{text}</p>"] * 6 + [
            f"<p{z}><b{z}>{text}<br><p{z}>{_text(rng, n)}</p>",
            f"<p{z}><b{z}>{text}<br>",
            f"<p{z}><b{z}>{_text(rng, 6)}<br>",
            f"<p{z}><b{z}>{text}</b></p>",
            f"<h2{z}>{_text(rng, 4)}</h2>",
            f"<p{z}>{text} <a{z} href=/z>{_text(rng, 2)}</a> <em{z}>{_text(rng, 3)}</em></p>",
            f"<ul{z}>" + "".join(f"<li{z}>{_text(rng, rng.randint(3, 15))}</li>" for _ in range(4)) + "</ul>",
            f"<blockquote{z}><p{z}>{text}</p></blockquote>",
            f"<table{z}><tr{z}><th{z}>{_text(rng, 2)}</th><td{z}>{_text(rng, 5)}</td></tr></table>",
            f"<pre{z}><code{z}>{text}</code></pre>",
            f"<figure{z}><img src=x><figcaption{z}>{_text(rng, 5)}</figcaption></figure>",
            f"<div{z}>{text}</div>",
            f"<section{z}><h3{z}>{_text(rng, 3)}</h3><p{z}>{text}</p></section>",
        ])

    pages = []
    for _ in range(n):
        z = " itemprop=zz"
        inner = "".join(content() for _ in range(rng.choice([0, 1, 1, 1, 2, 6, 12])))
        tucked = "".join(rng.choice([beside, comments])() for _ in range(rng.choice([0, 0, 0, 1])))
        frame = rng.choice(["article", "article", "main", "div class=content", "div id=main", "div class='post body'", "div class=article"])
        body = f"<{frame}{z}><h1{z}>{_text(rng, 5)}</h1>{inner}{tucked}</{frame.split()[0]}>"
        if rng.random() < 0.3:
            body = f"<{rng.choice(['div class=wrapper', 'main', 'div id=page'])}{z}>{body}"
        head = rng.choice(["", f"<header><h1>{_text(rng, 2)}</h1><p>{_text(rng, 6)}</p></header>", f"<div class=header><a href=/>{_text(rng, 2)}</a></div>"])
        foot = rng.choice([f"<footer>{_text(rng, 9)}</footer>", f"<div class=footer><p>{_text(rng, 6)}</p></div>", f"<footer><p>{_text(rng, 8)}</p><a href=/>{_text(rng, 1)}</a></footer>"])
        sides = "".join(beside() for _ in range(rng.randint(0, 3)))
        late = "".join(rng.choice([beside, comments])() for _ in range(rng.randint(0, 2)))
        pages.append(f"<html><head><title>{_text(rng, 4)}</title></head><body>{head}{menu()}{sides}{body}{late}{foot}</body></html>")
    return pages


@cache
def fitted(pages: int = 200, seed: int = 5, rounds: int = 60) -> tuple[dict[str, float], list[list[float]]]:
    """Weights of features and of parent-child pairs, by gradient ascent (Adagrad) on the log likelihood."""
    data = []
    for html in labelled_pages(pages, seed):
        nodes, _ = parse(html)
        labels = [int("zz" in node.marks.split()) for node in nodes]
        for node in nodes:
            node.marks = node.marks.replace("zz", "").strip()
        for k, node in enumerate(nodes):  # what holds content and nothing else is content's frame, not content
            if node.tag in ("#root", "html", "body"):
                labels[k] = 0
        data.append((nodes, labels, [features(node) for node in nodes]))
    names = sorted({f for _, _, rows in data for row in rows for f in row})
    at = {f: k for k, f in enumerate(names)}
    indexed = [(nodes, labels, [[at[f] for f in row] for row in rows]) for nodes, labels, rows in data]
    w, pair = np.zeros(len(names)), np.zeros((2, 4))
    seen_w, seen_pair = np.full(len(names), 1e-3), np.full((2, 4), 1e-3)
    for _ in range(rounds):
        grad, grad_pair = -0.5 * w, -0.5 * pair
        values = w.tolist()
        for nodes, labels, rows in indexed:
            p, joint = marginals(nodes, [sum([values[f] for f in row]) for row in rows], pair.tolist())
            for k, row in enumerate(rows):
                for f in row:
                    grad[f] += labels[k] - p[k]
                if k:
                    kind = _pairs(nodes[k])
                    grad_pair[kind, 2 * labels[nodes[k].parent] + labels[k]] += 1
                    grad_pair[kind] -= joint[k]
        seen_w += grad**2
        seen_pair += grad_pair**2
        w += 0.5 * grad / np.sqrt(seen_w)
        pair += 0.5 * grad_pair / np.sqrt(seen_pair)
    return dict(zip(names, w.tolist())), pair.tolist()


def main_text(html: str | None, weights: dict[str, float], ties: list[list[float]]) -> str:
    nodes, pieces = parse(html)
    p, _ = marginals(nodes, [sum([weights.get(f, 0.0) for f in features(node)]) for node in nodes], ties)
    blocks: list[tuple[int, list[str]]] = []
    for node, block, text in pieces:
        if p[node] > 0.5:
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(text)
    joined = (" ".join("".join(parts).split()) for _, parts in blocks)
    return " ".join(b for b in joined if b)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``text``, the main text of each whole page (empty if none).

    Null html is an empty page. Rows are read one by one: repeated rows and null ids stay. An empty table
    gives no rows; a column named text is replaced.
    """
    weights, ties = fitted()

    @F.pandas_udf("string")
    def texts(html):
        return html.map(lambda h: main_text(h, weights, ties))

    return pages.withColumn("text", texts(F.col(html_col)))
