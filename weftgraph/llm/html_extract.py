"""Main text of web pages: a linear-chain CRF over the leaf blocks of the page, decoded by Viterbi.

A page is cut into leaf blocks (text between block-level tags, inline markup resolved). Features
are the tags and class words of the block's ancestors and measures of its text; a chain over the
blocks joins neighbours. The CRF is trained on labelled pages that this module builds from many
page layouts (``training_pages``), each block labelled with the part of the layout it stands in.
"""

from __future__ import annotations

import html
import random
import re

from pyspark.sql import DataFrame

from weftgraph.llm._util import map_batches

#: HTML elements by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: So are embedded content and what it consists of.
INLINE |= frozenset("audio canvas iframe noscript object picture video math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose merror mmultiscripts svg g path circle ellipse rect line polyline polygon defs use symbol text tspan textpath desc".split())
#: Parts without text of the page; form controls among them.
DROPPED = frozenset("script style template head title select textarea".split())
#: What a head may hold: another tag, or text, ends one that is open.
HEAD = frozenset("base link meta title script style template".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: An opening tag of the key closes an open one of the value.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block-level tags close an open paragraph.
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_name = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_stop = re.compile(r"""[>"']""")
_attr = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_part = re.compile(r"[a-z]+")
_zeros, _beyond = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def decoded(text: str) -> str:
    """Character references decoded, white space as single blanks; numbers beyond Unicode are U+FFFD however long they are."""
    if "&" in text:
        text = html.unescape(_beyond.sub("\ufffd", _zeros.sub("&#", text)))
    return " ".join(text.split())


def scan(page: str):
    """(text, name, closing, attributes) of each tag with the text before it; name is empty for comments and at the end.

    One pass: a tag ends at the first ``>`` outside quotes, or at the first of all if quotes do not
    match; ``<`` that no ``>`` follows is text. Quotes from which no end was found are remembered, so
    that they are not followed again. The content of raw-text elements is skipped, or is text.
    """
    n, start, at = len(page), 0, 0
    last = {c: page.rfind(c) for c in ">\"'"}
    lost: set[int] = set()
    cdata = True

    def tag_end(p: int) -> int:
        q, seen = p, []
        while q <= last[">"]:
            m = _stop.search(page, q)
            if m[0] == ">":
                return m.start()
            if m.start() in lost or last[m[0]] == m.start():
                break
            seen.append(m.start())
            q = page.index(m[0], m.start() + 1) + 1
        lost.update(seen)
        return page.index(">", p)

    while (at := page.find("<", at)) >= 0:
        if at > last[">"]:
            at = page.find("<!--", at)  # an open comment takes the rest
            yield page[start : at if at >= 0 else n], "", False, ""
            return
        name, closing, attrs = "", False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = at + 5 if page.startswith(">", at + 4) else end + 3 if end >= 0 else n
        elif cdata and page.startswith("<![CDATA[", at) and (cdata := (end := page.find("]]>", at) + 3) > 2):
            pass
        elif page[at + 1] in "!?":
            end = page.index(">", at) + 1
        elif (m := _name.match(page, at + 1)) and m.end() <= last[">"]:
            end = tag_end(m.end())
            name, closing, attrs = m[2].lower(), bool(m[1]), page[m.end() : end]
            end += 1
        else:
            at += 1
            continue
        yield page[start:at], name, closing, attrs
        start = at = end
        if name in RAW and not closing:
            m = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = m.start() if m else n
            start = at if name in DROPPED else start
    yield page[start:], "", False, ""


class Page:
    """The leaf blocks of a page in order, and the elements that they stand in.

    ``blocks``: (text, tag, element, linked characters); character references are decoded, white
    space is one blank, blocks without text are left out. ``elements``: (parent, features that the
    element adds to those of its ancestors), the first for the page itself, so that what holds for
    a block is the sum over its ancestors, and depth costs nothing. Null and empty pages have none.
    """

    def __init__(self, page: str | None):
        self.blocks: list[tuple[str, str, int, int]] = []
        self.elements: list[tuple[int, tuple[str, ...]]] = [(-1, ())]
        self.stack: list[tuple[str, list[str], int]] = []
        self.open: dict[str, int] = {}  # elements by name, and features, that are open
        self.buf: list[str] = []
        self.linked = self.in_link = self.dropped = 0
        for text, name, closing, attrs in scan(page or ""):
            self._take(text, name, closing, attrs)
        self._flush()

    def _flush(self):
        text = decoded("".join(self.buf))
        if text:
            tag, _, element = self.stack[-1] if self.stack else ("body", [], 0)
            self.blocks.append((text, tag, element, min(self.linked, len(text))))
        self.buf.clear()
        self.linked = 0

    def _push(self, name: str, attrs: str):
        # what stands at html and body holds for all blocks of the page alike
        words = {w for a in _attr.finditer(attrs) for w in _part.findall((a[1] or a[2] or a[3] or "").lower())} if name not in ("html", "body") else ()
        own = [name, f"in={name}", *(f"cls={w}" for w in sorted(words))]
        if name in ("article", "main") or self.open.get("article") or self.open.get("main"):
            own.append(f"content>{name}")
        added = tuple(f for f in own[1:] if f not in self.open)
        for f in own:
            self.open[f] = self.open.get(f, 0) + 1
        self.elements.append((self.stack[-1][2] if self.stack else 0, added))
        self.stack.append((name, own, len(self.elements) - 1))
        self.dropped += name in DROPPED

    def _pop(self) -> str:
        name, own, _ = self.stack.pop()
        for f in own:
            self.open[f] -= 1
            if not self.open[f]:
                del self.open[f]
        self.dropped -= name in DROPPED
        return name

    def _take(self, text: str, name: str, closing: bool, attrs: str):
        if self.stack and self.stack[-1][0] == "head" and (text.strip() or name and not closing and name not in HEAD):
            self._pop()
        if text and not self.dropped:
            self.buf.append(text)
            if self.in_link:
                self.linked += len(text)
        if not name:
            return
        if name in INLINE:
            if name in ("br", "text", "desc"):
                self.buf.append(" ")
            elif name == "a":
                self.in_link = max(0, self.in_link + (-1 if closing else 1))
            return
        self._flush()
        self.in_link = 0
        if closing:
            while name in self.open and self._pop() != name:
                pass
            return
        while name in CLOSE_P and "p" in self.open:
            self._pop()
        while self.stack and self.stack[-1][0] in CLOSES.get(name, ()):
            self._pop()
        if name not in VOID and not (attrs.endswith("/") and name in ("svg", "path")):
            self._push(name, attrs)

    def own_features(self, i: int) -> list[str]:
        """What the tag and the text of a block say."""
        text, tag, _, linked = self.blocks[i]
        n, words = len(text), text.count(" ") + 1
        out = ["bias", f"tag={tag}", f"len={min(6, words.bit_length())}", f"link={round(3 * linked / n)}", f"stop={min(3, sum(text.count(c) for c in '.!?'))}"]
        if text[:1] in "©®" or "©" in text[:80]:
            out.append("copyright")
        if i == 0:
            out.append("first")
        if i == len(self.blocks) - 1:
            out.append("last")
        return out

    def features(self, i: int) -> list[str]:
        """Those of a block and of all elements that it stands in."""
        out, at = self.own_features(i), self.blocks[i][2]
        while at >= 0:
            at, added = self.elements[at]
            out += added
        return out

    def scores(self, weights: dict[str, tuple[float, float]]) -> list[tuple[float, float]]:
        """Sums of the weights of each block's features, for both labels; an element's sum starts from its parent's."""
        def plus(s, fs):
            a, b = s
            for f in fs:
                if f in weights:
                    a += weights[f][0]
                    b += weights[f][1]
            return a, b

        sums: list[tuple[float, float]] = []
        for parent, added in self.elements:
            sums.append(plus(sums[parent] if parent >= 0 else (0.0, 0.0), added))
        return [plus(sums[b[2]], self.own_features(i)) for i, b in enumerate(self.blocks)]


# --- the chain ---------------------------------------------------------------------------------


def viterbi(unary, trans) -> list[int]:
    """The best labels (0, 1) of a chain."""
    if not len(unary):
        return []
    (a, b), (c, d) = ((float(x) for x in row) for row in trans)
    back = []
    s, t = (float(x) for x in unary[0])
    for u, v in unary[1:]:
        back.append((t + c > s + a, t + d > s + b))
        s, t = max(s + a, t + c) + u, max(s + b, t + d) + v
    labels = [int(t > s)]
    for from_ in reversed(back):
        labels.append(int(from_[labels[-1]]))
    return labels[::-1]


def train(pages, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3):
    """Weights by gradient ascent on the conditional likelihood (forward-backward, AdaGrad).

    ``pages``: lists of (features, label) pairs, one list per page.
    """
    import numpy as np

    index: dict[str, int] = {}
    for page in pages:
        for fs, _ in page:
            for f in fs:
                index.setdefault(f, len(index))
    t, p = max(map(len, pages)), len(pages)
    rows = [(i, j, index[f]) for i, page in enumerate(pages) for j, (fs, _) in enumerate(page) for f in fs]
    pi, ji, fi = (np.array(x) for x in zip(*rows, strict=True))
    lengths = np.array([len(x) for x in pages])
    gold = np.zeros((p, t), int)
    for i, page in enumerate(pages):
        gold[i, : len(page)] = [y for _, y in page]
    on = np.arange(t)[None, :] < lengths[:, None]
    w, a = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, ga = np.full_like(w, 1e-8), np.full_like(a, 1e-8)
    for _ in range(rounds):
        u = np.zeros((p, t, 2))
        np.add.at(u, (pi, ji), w[fi])
        fwd, bwd = np.zeros((p, t, 2)), np.zeros((p, t, 2))
        fwd[:, 0] = u[:, 0]
        for j in range(1, t):
            nxt = np.logaddexp.reduce(fwd[:, j - 1, :, None] + a[None], axis=1) + u[:, j]
            fwd[:, j] = np.where(on[:, j, None], nxt, fwd[:, j - 1])
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        for j in range(t - 2, -1, -1):
            nxt = np.logaddexp.reduce(a[None] + (u[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2)
            bwd[:, j] = np.where(on[:, j + 1, None], nxt, 0.0)
        marg = np.exp(fwd + bwd - z[:, None, None]) * on[..., None]
        diff = np.eye(2)[gold] * on[..., None] - marg
        dw = np.zeros_like(w)
        np.add.at(dw, fi, diff[pi, ji])
        dw = dw / p - ridge * w
        pair = np.exp(fwd[:, :-1, :, None] + a[None, None] + (u[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        have = np.zeros((2, 2))
        np.add.at(have, (gold[:, :-1][on[:, 1:]], gold[:, 1:][on[:, 1:]]), 1)
        da = (have - pair.sum((0, 1))) / p - ridge * a
        gw += dw**2
        ga += da**2
        w += rate * dw / np.sqrt(gw)
        a += rate * da / np.sqrt(ga)
    return {"w": {f: (float(w[k, 0]), float(w[k, 1])) for f, k in index.items()}, "trans": a}


# --- labelled pages ----------------------------------------------------------------------------


def training_pages(n: int = 260, seed: int = 7):
    """Labelled pages of varied layouts: (html, set of the main text's block texts)."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcdefghijklmnoprstuvwzéüñ") for _ in range(rng.randint(2, 9)))

    def words(a, b):
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a=4, b=18):
        return words(a, b).capitalize() + rng.choice("..?!")

    def prose(a=1, b=6):
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    out = []
    for _ in range(n):
        good: set[str] = set()

        def keep(text, good=good):
            good.add(" ".join(text.split()))
            return text

        def links(k):
            return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

        def block():
            kind = rng.random()
            if kind < 0.7:
                return f"<p>{keep(prose())}</p>"
            if kind < 0.78:
                return f"<h{(h := rng.randint(2, 4))}>{keep(words(2, 7))}</h{h}>"
            if kind < 0.86:
                return "<ul>" + "".join(f"<li>{keep(prose(1, 2))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            if kind < 0.92:
                return f"<blockquote><p>{keep(prose())}</p></blockquote>"
            if kind < 0.96:
                return f"<table><tr><td>{keep(words(1, 4))}</td><td>{keep(words(1, 4))}</td></tr></table>"
            return f"<pre>{keep(words(3, 20))}</pre>"

        def junk():
            return rng.choice([
                lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"])}">{prose(1, 3)}</div>',
                lambda: f'<aside class="{rng.choice(["sidebar", "related", "widget", "widget-area", "widget-area sidebar"])}"><h3>{words(1, 3)}</h3><ul>{links(4)}</ul><p>{prose(1, 2)}</p></aside>',
                lambda: f'<div class="{rng.choice(["cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "newsletter", "alert"])}"><p>{prose(1, 2)}</p></div>',
                lambda: f"<form><label>{words(1, 3)}</label><p>{prose(1, 2)}</p><button>{word()}</button></form>",
                lambda: f'<section class="{rng.choice(["share", "social", "related-posts", "recommended"])}"><p>{words(1, 5)}</p></section>',
                lambda: f'<div class="breadcrumbs"><a href="/">{word()}</a> / <a href="/x">{word()}</a></div>',
            ])()

        def comments():
            name = rng.choice(["comments", "comment-list", "comments-area", "comment", "disqus", "replies", "responses", "discussion"])
            one = f'<div class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{prose(1, 4)}</p></div>'
            tag = rng.choice(["section", "div", "ol"])
            return f'<{tag} {rng.choice(["id", "class"])}="{name}"><h3>{words(1, 2)}</h3>{one * rng.randint(1, 4)}</{tag}>'

        body = [f"<h1>{keep(words(3, 9))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            body.append(block())
            if rng.random() < 0.15:
                body.append(junk())
        inner = "".join(body)
        shell = rng.random()
        if shell < 0.5:
            inner = f"<article>{inner}</article>"
        elif shell < 0.65:
            inner = f"<main>{inner}</main>"
        elif shell < 0.9:
            inner = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "entry", "entry-content", "article", "post-body", "article-body", "story-body", "article-content", "main", "story", "text"])}">{inner}</div>'
        if rng.random() < 0.3:
            inner += comments()
        if rng.random() < 0.3:  # a frame around the article and what belongs to it
            around = [inner, comments(), junk()][: rng.randint(1, 3)]
            frame = rng.choice(["main", 'div class="site-content"', 'div id="primary"', 'div class="column"', 'section class="single"'])
            inner = f"<{frame}>{''.join(around)}</{frame.split()[0]}>"
        parts = []
        if rng.random() < 0.8:
            parts.append(f'<{rng.choice(["nav", "div class=menu", "div id=navigation", "ul class=nav", "nav class=main-navigation", "nav class=site-menu"])}>' .replace("ul class", "div class") + f"<ul>{links(rng.randint(2, 7))}</ul>" + "</div></nav>")
        if rng.random() < 0.5:
            parts.insert(0, f"<{rng.choice(['header', 'header class=site-header', 'header id=masthead'])}><h2>{words(1, 4)}</h2><p>{prose(1, 2)}</p></header>")
        parts += [junk() for _ in range(rng.randint(0, 2))] + [inner] + [junk() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.8:
            parts.append(f"<{(f := rng.choice(['footer', 'div class=footer', 'div id=footer']))}>&copy; {words(1, 3)} &middot; {prose(1, 3)}</{f.split()[0]}>")
        body = "".join(parts)
        if rng.random() < 0.4:  # all of the page in a shell
            body = f'<div {rng.choice(["id", "class"])}="{rng.choice(["page", "wrapper", "container", "site", "root", "app", "layout"])}">{body}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>", good))
    return out


_model: dict = {}


def model(n: int = 260, seed: int = 7):
    """The trained CRF; trained once per process."""
    if (n, seed) not in _model:
        pages = []
        for page, good in training_pages(n, seed):
            found = Page(page)
            if found.blocks:
                pages.append([(found.features(i), int(b[0] in good)) for i, b in enumerate(found.blocks)])
        _model[n, seed] = train(pages)
    return _model[n, seed]


def extract(page: str | None, crf) -> str:
    """The main text of one page; blocks joined by two line feeds."""
    found = Page(page)
    labels = viterbi(found.scores(crf["w"]), crf["trans"])
    return "\n\n".join(b[0] for b, y in zip(found.blocks, labels, strict=True) if y)


def extract_pages(pages: DataFrame, out: str = "text") -> DataFrame:
    """page_id, url, text, n_chars of every page; null and empty html give empty texts.

    One pass, no shuffle; repeated rows give repeated results; other columns are not read. Pages of
    any length and nesting, malformed ones too, take time in proportion to their length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def make():
        crf = shared.value

        def fn(cols):
            texts = [extract(h, crf) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], out: texts, "n_chars": [len(t) for t in texts]}

        return fn

    return map_batches(pages.select("page_id", "url", "html"), make, f"page_id bigint, url string, `{out}` string, n_chars bigint")
