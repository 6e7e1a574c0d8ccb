"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of blocks: runs of text between block-level tags, with character references decoded and white space
single. Each block is described by hashed vectors of its tag path (element names, words of class, id and role) and of all
its words, and by a few sizes; a bidirectional LSTM in numpy reads the blocks of the whole page both ways and labels each of
them, so that a block is judged by what stands before and after it. What is labelled text, joined in page order, is the
article. Scoring is one scan without a shuffle; pages of similar length go through the network together.

The network is fitted on the driver from a bounded sample of pages that mark their article (``sample``, in the order of a hash
of the id): blocks under an article or main element are text, unless under a menu, aside, form and so on. As many pages again
are composed from the sample's texts in varied layouts, so that other element names and classes, and comments or notices with
the words of an article, are learned too (``layouts`` a page). Without such pages the layouts are filled with fixed words.

Defined results: a null or empty html, or one without text, gives the empty string. White space is that of ``str.split``.
Tags that are not closed, quotes that are not closed and cut character references are read as browsers do in the main. Memory
follows a batch of pages or the longest page. Repeated rows get a result each; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table
from ._text import Block, Hasher, U

PATH_BINS, WORD_BINS, SIZES = 256, 64, 7
INPUT, MIDDLE, HIDDEN = PATH_BINS + WORD_BINS + SIZES, 24, 16

#: Elements that do not end a block, elements without content, and elements whose content is not text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style template textarea title iframe svg math xmp noembed noframes"
#: Elements that an open p stays around.
_IN_P = INLINE | VOID - {"hr"} | frozenset("button label object map noscript audio video canvas".split())
#: An element of the first kinds ends with the start of the key, up to a container of the second kinds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select", "datalist"}),
}
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"[\s\"'](?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_KEEP = re.compile(r"\sdata-keep=([01])")
_TOKEN = re.compile(r"[a-z]+")


def _bin(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BINS


class Reader:
    """Pages as blocks. Paths are interned: ``bins[node]`` are the bins of a path's names, ``label[node]`` what its landmarks say."""

    IGNORE, SPACE, LINK, UNLINK, OPEN, CLOSE, BREAK = range(7)

    def __init__(self):
        self.tags: dict[str, tuple] = {}
        self.nodes: dict[tuple[int, str], int] = {}
        self.bins, self.own, self.label = [frozenset()], [0], [None]

    def _tag(self, raw: str) -> tuple:
        """What a piece of markup does, its element's name, its names in the path and its landmark."""
        name = _NAME.match(raw)
        name = name[1].lower() if name else ""
        if not name or name in RAW.split():
            return self.IGNORE, name, (), None
        if name == "a":
            return (self.UNLINK if raw[1] == "/" else self.LINK), name, (), None
        if name in INLINE:
            return self.IGNORE, name, (), None
        if name in VOID:
            return (self.SPACE if name == "br" else self.BREAK if name == "hr" else self.IGNORE), name, (), None
        if raw[1] == "/":
            return self.CLOSE, name, (), None
        names = (name, *(f".{t}" for v in _NAMED.findall(raw) for t in _TOKEN.findall(v.lower())))
        keep = _KEEP.search(raw)
        return self.OPEN, name, names, int(keep[1]) if keep else landmark(name, names)

    def _node(self, parent: int, raw: str, tag: tuple) -> int:
        key = (parent, raw)
        if key not in self.nodes:
            added = {_bin(t) for t in tag[2]}
            self.nodes[key] = len(self.bins)
            self.bins.append(self.bins[parent] if added <= self.bins[parent] else self.bins[parent] | added)
            self.own.append(_bin(f"own {tag[1]}"))
            # what is left out stays so below; an article's own header is part of it
            above, own = self.label[parent], tag[3]
            self.label.append(own if above is None or own == 0 and above == 1 and tag[1] != "header" else above)
        return self.nodes[key]

    def blocks(self, html: str) -> list[tuple[str, int, int]]:
        """(text, path, characters inside links) of each block, in page order."""
        out, buffer, linked, link = [], [], 0, False
        stack: list[tuple[str, int]] = []
        count: dict[str, int] = {}
        node = at = 0

        def flush():
            nonlocal linked
            if buffer:
                text = "".join(buffer)
                buffer.clear()
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    out.append((text, node, linked))
            linked = 0

        def cut(n: int):
            nonlocal node
            for name, _ in stack[n:]:
                count[name] -= 1
            del stack[n:]
            node = stack[-1][1] if stack else 0

        for m in _MARKUP.finditer(html):
            start = m.start()
            if start > at:
                buffer.append(html[at:start])
                linked += (start - at) * link
            at, raw = m.end(), m[0]
            tag = self.tags.get(raw)
            if tag is None:
                tag = self._tag(raw)
                if len(raw) < 200:
                    self.tags[raw] = tag
            kind, name = tag[0], tag[1]
            if kind == self.IGNORE:
                continue
            if kind == self.SPACE:
                buffer.append(" ")
            elif kind == self.LINK:
                link = True
            elif kind == self.UNLINK:
                link = False
            elif kind == self.CLOSE:
                if count.get(name):
                    flush()
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    cut(k)
            else:
                flush()
                if count.get("p") and name not in _IN_P:
                    k = len(stack) - 1
                    while stack[k][0] != "p":
                        k -= 1
                    cut(k)
                if name in _ENDS and any(count.get(x) for x in _ENDS[name][0]):
                    kinds, within = _ENDS[name]
                    k, found = len(stack) - 1, None
                    while k >= 0 and stack[k][0] not in within:
                        found = k if stack[k][0] in kinds else found
                        k -= 1
                    if found is not None:
                        cut(found)
                if kind == self.OPEN:
                    node = self._node(node, raw, tag)
                    stack.append((name, node))
                    count[name] = count.get(name, 0) + 1
        buffer.append(html[at:])
        linked += (len(html) - at) * link
        flush()
        return out


#: Names that mark an article, and names that mark what is left out, with the words of classes that layouts give them.
ARTICLE = ("article", "main", "div.content", "div.post-body", "section.story", "div.entry-content", "div.main-content", "div.article-text", "div.post", "section.article")
LEFT_OUT = {
    "menu": ("nav", "ul.menu", "div.navbar", "div.navigation", "div.breadcrumbs", "div.nav-links", "menu"),
    "header": ("header", "div.masthead", "div.site-header", "div.topbar"),
    "footer": ("footer", "div.footer", "div.site-info", "div.copyright", "div.legal"),
    "side": ("aside", "div.sidebar", "div.related", "div.widget", "div.teaser", "section.recommended"),
    "notice": ("div.cookie-notice", "div.consent", "div.banner", "div.alert", "noscript", "div.notice", "div.popup"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo"),
    "form": ("form", "div.newsletter", "div.login", "div.subscribe", "fieldset"),
    "comments": ("section.comments", "div.comment-list", "div.comments", "ol.commentlist", "div.replies", "div.discussion"),
}
_OUT_TAGS = frozenset("nav menu header footer aside noscript form fieldset button select dialog".split())
_OUT_WORDS = frozenset(f".{w}" for kind in LEFT_OUT.values() for n in kind if "." in n for w in re.findall(r"[a-z]+", n.split(".")[1])) - {".site", ".list", ".info", ".section"}


def landmark(name: str, names: tuple[str, ...]) -> int | None:
    """Whether an element marks text of the article (1), what is left out (0) or neither (None)."""
    if name in _OUT_TAGS or not _OUT_WORDS.isdisjoint(names):
        return 0
    return 1 if name in ("article", "main") else None


def place(pages: list[list]) -> np.ndarray:
    """Where blocks stand in their pages, from 0 up to 1, one page after the other."""
    return np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages])


def describe(every: list[tuple[str, int, int]], where: np.ndarray, reader: Reader) -> np.ndarray:
    """The input vectors of blocks, given where they stand in their pages."""
    n = len(every)
    x = np.zeros((n, INPUT), np.float32)
    for i, (_, node, _) in enumerate(every):
        bins = reader.bins[node]
        x[i, list(bins)] = 1
        x[i, reader.own[node]] += 1
    data = [b[0].encode("utf-8", "surrogatepass") for b in every]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    block = Block(0, np.frombuffer(b"".join(data), np.uint8), at)
    start, end, words = block.words()
    hashed = (Hasher(block.data)(start, end) % U(WORD_BINS)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(words))
    counts = np.bincount(owner * WORD_BINS + hashed, minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    number = np.maximum(np.diff(words), 1)
    x[:, PATH_BINS : PATH_BINS + WORD_BINS] = counts / np.sqrt((counts**2).sum(1, keepdims=True).clip(1))
    long = np.array([len(b[0]) for b in every])
    linked = np.minimum([b[2] for b in every], long)
    stops = np.array([b[0][-1] in ".!?…" for b in every])
    x[:, -SIZES:] = np.column_stack([np.log1p(long) / 6, np.log1p(number) / 5, linked / long, stops, where, 1 - where, np.minimum(long / number, 20) / 10])
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Labeller:
    """A hidden layer, one LSTM each way over a page's blocks, and a logistic output."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": draw(INPUT, MIDDLE) * 4, "e": np.zeros(MIDDLE, np.float32), "o": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": draw(MIDDLE, 4 * HIDDEN), f"R{way}": draw(HIDDEN, 4 * HIDDEN), f"c{way}": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)}

    def _run(self, z: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (T, N, HIDDEN) for inputs ``z`` (T, N, MIDDLE); steps where ``mask`` is 0 leave the state as it is."""
        w, r, c = (self.p[f"{k}{way}"] for k in "WRc")
        steps, n = z.shape[:2]
        pre = z @ w + c
        h, s = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else reversed(range(steps)):
            a = pre[t] + h @ r
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            fresh = f * s + i * g
            held = np.tanh(fresh)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, s, i, f, o, g, held, m))
            h, s = np.where(m, o * held, h), np.where(m, fresh, s)
            out[t] = h
        return out

    def embed(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["E"] + self.p["e"])

    def score(self, z: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities (T, N) that blocks are text, from embedded inputs."""
        h = np.concatenate([self._run(z, mask, "f"), self._run(z, mask, "b")], 2)
        return _sigmoid(h @ self.p["o"] + self.p["b"])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss of the blocks where ``mask`` is set, and its gradient; arrays are (T, N, ...)."""
        z = self.embed(x)
        tape: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(z, mask, way, tape[way]) for way in "fb"], 2)
        q = _sigmoid(h @ self.p["o"] + self.p["b"])
        total = max(1, int(mask.sum()))
        loss = -(np.log(np.where(y > 0, q, 1 - q).clip(1e-7)) * mask).sum() / total
        d = ((q - y) * mask / total).astype(np.float32)
        grad = {"o": np.einsum("tn,tnh->h", d, h), "b": d.sum(keepdims=True).reshape(1)}
        dz = np.zeros_like(z)
        for k, way in enumerate("fb"):
            w, r = self.p[f"W{way}"], self.p[f"R{way}"]
            dh_out = d[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dr = np.zeros_like(r)
            da = np.zeros((*z.shape[:2], 4 * HIDDEN), np.float32)
            dh, ds = np.zeros_like(h[0, :, :HIDDEN]), np.zeros_like(h[0, :, :HIDDEN])
            for t, before, s, i, f, o, g, held, m in reversed(tape[way]):
                up = dh + dh_out[t]
                live = up * m
                dfresh = live * o * (1 - held**2) + ds * m
                da[t] = np.concatenate([dfresh * g * i * (1 - i), dfresh * s * f * (1 - f), live * held * o * (1 - o), dfresh * i * (1 - g**2)], 1)
                dr += before.T @ da[t]
                dh = da[t] @ r.T + up * ~m
                ds = dfresh * f + ds * ~m
            grad |= {f"R{way}": dr, f"W{way}": np.einsum("tnm,tnk->mk", z, da, optimize=True), f"c{way}": da.sum((0, 1))}
            dz += da @ w.T
        dz *= 1 - z**2
        grad |= {"E": x.reshape(-1, INPUT).T @ dz.reshape(-1, MIDDLE), "e": dz.sum((0, 1))}
        return float(loss), grad

    def fit(self, x: list[np.ndarray], y: list[np.ndarray], rounds: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Labeller:
        """Adam on pages in batches of similar length."""
        r = np.random.default_rng(seed)
        order = np.argsort([len(v) for v in x], kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for turn in range(rounds):
            for g in r.permutation(len(groups)):
                xs, mask = padded([x[i] for i in groups[g]])
                _, grad = self.gradient(xs, mask, padded([y[i][:, None] for i in groups[g]])[0][:, :, 0])
                step += 1
                size = np.sqrt(sum(float((d**2).sum()) for d in grad.values()))
                for k, d in grad.items():
                    d = d * min(1.0, 1 / (size + 1e-12))
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    self.p[k] -= (rate * (1 - turn / rounds) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of vectors as (T, N, width) and the mask (T, N) of what is theirs."""
    steps = max(len(a) for a in rows)
    out, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), bool)
    for i, a in enumerate(rows):
        out[: len(a), i], mask[: len(a), i] = a, True
    return out, mask


_WORDS = "the of and a river stone light morning under road paper small window house water green city letter night"


def layout(texts: list[str], short: list[str], r: random.Random) -> str:
    """A page of some of ``texts`` as paragraphs, with ``short`` ones in menus and the like; ``data-keep`` tells what is the article."""

    def element(kind: str, inner: str, keep: int) -> str:
        name, _, classes = kind.partition(".")
        given = f" {r.choice(('class', 'class', 'id'))}=\"{classes}{r.choice(('', '', ' box', ' col-2'))}\"" if classes else ""
        return f"<{name}{given} data-keep={keep}>{inner}</{name}>"

    text = lambda: f"<p>{escape(r.choice(texts))}</p>"
    word = lambda: escape(r.choice(short))
    links = lambda: "".join(f"<li><a href='#'>{word()}</a></li>" for _ in range(r.randint(2, 8)))

    def part(kind: str) -> str:
        plain = r.choice((f"<p>{word()}</p>", word(), text(), f"<h3>{word()}</h3>{text()}", f"<ul>{links()}</ul>"))
        inner = {
            "menu": links(), "form": f"<label>{word()}</label><button>{word()}</button><p>{word()}</p>",
            "comments": f"<h3>{word()}</h3>" + "".join(f"<div class='comment'><span>{word()}</span>{text()}</div>" for _ in range(r.randint(1, 4))),
        }.get(kind, plain)
        return element(r.choice(LEFT_OUT[kind]), inner, 0)

    some = lambda kinds, chance: "".join(part(k) for k in kinds if r.random() < chance)
    body = [r.choice((f"<h1>{word()}</h1>", f"<h2>{word()}</h2>", f"<header data-keep=1><h1>{word()}</h1></header>", ""))]
    for _ in range(r.choice((1, 2, 3, 5, 8))):
        body.append(r.choice((text(), text(), text(), text(), f"<h2>{word()}</h2>{text()}", f"<ul><li>{escape(r.choice(texts))}</li></ul>", f"<p>{word()}<br><p>{escape(r.choice(texts))}", f"<blockquote>{text()}</blockquote>", f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>")))
        if r.random() < 0.12:
            body.append(part(r.choice(("advert", "side", "form", "notice"))))
    if r.random() < 0.25:
        body.append(part("comments"))
    article = element(r.choice(ARTICLE), "".join(body), 1)
    if r.random() < 0.4:
        article = f"<div class='{r.choice(('row', 'columns', 'inner', 'layout'))}'>{some(['side'], 0.3)}{article}{some(['side'], 0.3)}</div>"
    before, after = some(("notice", "header", "menu", "advert", "side"), 0.5), some(("comments", "side", "advert", "form", "menu", "notice", "footer"), 0.45)
    page = before + article + after
    return f"<html><head><title>{word()}</title></head><body>" + (f"<div class='{r.choice(('page', 'wrapper', 'container'))}'>{page}</div>" if r.random() < 0.5 else page) + "</body></html>"


def train(pages: DataFrame, sample: int = 200, layouts: int = 3) -> Labeller:
    """Fits on at most ``sample`` pages that mark their article, and ``layouts`` composed pages for each."""
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # ids alone are sorted; the pages of those taken are fetched by a second scan
    picked = marked.where("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = marked.join(F.broadcast(picked), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy(F.xxhash64("page_id"), "page_id").collect()
    reader, r = Reader(), random.Random(7)
    read = [reader.blocks(row["html"]) for row in rows]
    texts = [t for p in read for t, node, _ in p if reader.label[node] == 1] or [" ".join(r.choice(_WORDS.split()) for _ in range(r.randint(3, 60))) for _ in range(200)]
    short = [t for p in read for t, node, _ in p if reader.label[node] == 0] or _WORDS.split()
    read += [reader.blocks(layout(texts, short, r)) for _ in range(layouts * max(len(rows), sample // 4))]
    read = [p for p in read if p]
    x = describe([b for p in read for b in p], place(read), reader)
    at = np.cumsum([0] + [len(p) for p in read])
    y = [np.array([reader.label[node] == 1 for _, node, _ in p], np.float32) for p in read]
    return Labeller().fit([x[i:j] for i, j in zip(at, at[1:])], y)


def _texts(htmls: list[str | None], model: Labeller, together: int = 128, chunk: int = 4096) -> list[str]:
    reader = Reader()
    pages = [reader.blocks(h) if h else [] for h in htmls]
    found = [""] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        # the longest first; many short pages, or one long page, make up a group
        take = max(1, min(together, 16 * chunk // len(pages[order[-1]])))
        group, order = order[-take:], order[:-take]
        flat, where = [b for i in group for b in pages[i]], place([pages[i] for i in group])
        z = np.concatenate([model.embed(describe(flat[k : k + chunk], where[k : k + chunk], reader)) for k in range(0, len(flat), chunk)])
        z, mask = padded(np.split(z, np.cumsum([len(pages[i]) for i in group])[:-1]))
        keep = model.score(z, mask) >= 0.5
        for k, i in enumerate(group):
            found[i] = " ".join(b[0] for b, good in zip(pages[i], keep[: len(pages[i]), k]) if good)
    return found


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text) of every page; needs columns page_id, url and html."""

    def rows(batches):
        for batch in batches:
            texts = _texts(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every page's main text and its length in code points."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, train(pages)).withColumn("n_chars", F.char_length("text").cast("long"))
