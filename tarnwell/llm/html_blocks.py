"""HTML main text by a recurrent block labeller, trained and run in numpy.

A page is read into its leaf blocks: stretches of text between block-level
tags, each with the path of tags (and their classes and ids) above it.  A block
becomes a vector of hashed path tokens, hashed words and a few figures, and a
bidirectional LSTM reads the whole sequence, so that each block is judged with
the document around it.  Blocks of probability one half or more are main text.

There are no labels, so the labeller learns from distant ones: on a bounded
sample (TRAIN_PAGES pages, of each at most TRAIN_BLOCKS neighbouring blocks at a
place that a hash gives, of each block at most BLOCK_CHARS characters; documented
parameters) blocks under article or main are main text, and blocks under nav,
footer, forms, adverts and the like are not, the nearest telling tag deciding.
Where no page of the sample has such a main text, rebuilt pages alone teach, of
the blocks that nothing tells against.  Three of four training sequences are
rebuilt: path names are replaced by plain ones, and menus, notices, sidebars,
forms and reader comments made from other blocks are put around the article.
So the labeller must also use words, figures and neighbours.  Extraction itself
looks at no rule, only at the labeller.

Reading is one pass of linear work whatever the markup: a tag ends at the first
> outside its quoted values, a tag that never ends takes the rest of the page,
elements nested deeper than DEEPEST are read as their parent's (as browsers
do), and a block keeps the last NAMES_KEPT names of its path.

Defined cases: null html is the empty page with empty text; broken or unclosed
markup is read as browsers do for the usual cases (paragraphs and list items
close each other, unknown end tags are ignored); scripts, styles, drawings and
frames inside a line of text vanish without splitting its block; null ids and
urls are kept; repeated rows give equal results; other columns are not touched;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import whole_text

TRAIN_PAGES, TRAIN_BLOCKS, BLOCK_CHARS = 300, 200, 2000
EPOCHS, BATCH, RATE = 6, 24, 0.01
DEEPEST, NAMES_KEPT = 512, 8
PATH_DIM, WORD_DIM, HIDDEN, REBUILT = 128, 32, 16, 3
TOGETHER = 60_000

#: Fixed values of HTML: elements with no content, with text that is no markup, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
PARAGRAPH_HOLDERS = frozenset("div article section td li body main blockquote".split())
ITEM_HOLDERS = frozenset("ul ol select table dl".split())
CELL_HOLDERS = frozenset("tr table".split())
#: Telling names for the distant labels.
MAIN = frozenset("article main".split())
OTHER = frozenset("nav footer header aside form button select menu dialog option label".split())
TELLING = re.compile(r"(?:^|[-_\s])(ads?|advert\w*|banner|sponsor\w*|menu|nav\w*|side-?bar|footer|header|comments?|reply|cookies?|notice|consent|promo|share|social|related|newsletter|subscribe|login|breadcrumbs?)(?:$|[-_\s])", re.I)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TO_QUOTE = re.compile("[^\"'>]*+")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Where rebuilt training pages put their parts: path and kind.
PARTS = (
    (("div.menu", "ul", "li", "a"), "menu"), (("div.nav-bar", "a"), "menu"), (("div.top", "ul", "li", "a"), "menu"), (("header", "div.brand"), "line"),
    (("div.cookie-notice", "p"), "line"), (("div.banner",), "line"), (("div.ad",), "line"), (("div.advert", "span"), "line"),
)
AFTER = (
    (("aside", "div.sidebar", "ul", "li", "a"), "menu"), (("div.sidebar", "p"), "line"), (("div.related", "ul", "li", "a"), "menu"), (("form.subscribe", "label"), "line"),
    (("section.comments", "div.comment", "p"), "comments"), (("div.comments", "ul", "li.comment", "p"), "comments"), (("div#comments", "div.reply"), "comments"),
    (("div.footer", "p"), "line"), (("footer",), "line"), (("div.ad",), "line"),
)


class Block:
    """A leaf block: the last names of its path and the path's length, its distant label, text and linked share."""

    __slots__ = ("depth", "label", "linked", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, linked: float, label: int | None = None, depth: int | None = None):
        self.path, self.text, self.linked, self.label = path[-NAMES_KEPT:], text, linked, label
        self.depth = len(path) if depth is None else depth


def named(tag: str, attributes: str) -> str:
    names = [x for m in NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()] if "=" in attributes else []
    return ".".join([tag, *names]).lower()


def told(name: str) -> int | None:
    """What one name of a path tells: 1 main text, 0 other."""
    tag, _, rest = name.partition(".")
    if tag in OTHER or (rest and TELLING.search(rest.replace(".", " "))):
        return 0
    return 1 if tag in MAIN else None


def tag_end(html: str, at: int) -> int:
    """Place of the > that ends a tag; the page's end where none does.  Quotes hold a value only after =."""
    while True:
        at = TO_QUOTE.match(html, at).end()
        if at >= len(html) or html[at] == ">":
            return at
        before = at - 1
        while html[before].isspace():
            before -= 1
        close = html.find(html[at], at + 1) if html[before] == "=" else -1
        at = close + 1 if close >= 0 else at + 1


def past(html: str, mark: str, at: int) -> int:
    found = html.find(mark, at)
    return len(html) if found < 0 else found + len(mark)


@lru_cache(maxsize=64)
def end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I)


class Open:
    """An open element: its tag, the last names of its path, how many those are, and what they tell."""

    __slots__ = ("depth", "label", "path", "tag")

    def __init__(self, tag: str, attributes: str, parent: Open | None):
        self.tag = tag
        self.path, self.depth, self.label = (parent.path, parent.depth, parent.label) if parent else ((), 0, None)
        if tag not in INLINE or tag == "a":
            name = named(tag, attributes)
            tells = told(name)
            self.path, self.depth = (*self.path, name)[-NAMES_KEPT:], self.depth + 1
            self.label = self.label if tells is None else tells


class Reader:
    """Reads a page's tags and texts into blocks."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Open] = []
        self.held: Counter[str] = Counter()  # open elements by tag
        self.passed: Counter[str] = Counter()  # elements too deep to be opened
        self.raw: list[str] = []
        self.links = self.chars = 0

    def flush(self) -> None:
        text = " ".join("".join(self.raw).split())
        if text:
            top = self.stack[-1] if self.stack else None
            path, depth, label = (top.path, top.depth, top.label) if top else ((), 0, None)
            self.blocks.append(Block(path, text, self.links / max(1, self.chars), label, depth))
        self.raw, self.links, self.chars = [], 0, 0

    def take(self, text: str) -> None:
        self.raw.append(unescape(text) if "&" in text else text)
        self.chars += len(text)
        if self.held["a"]:
            self.links += len(text)

    def close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        if not self.held[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                if any(x.tag not in INLINE for x in self.stack[k:]):
                    self.flush()
                for x in self.stack[k:]:
                    self.held[x.tag] -= 1
                del self.stack[k:]
                return
            if self.stack[k].tag in within:
                return

    def end(self, tag: str) -> None:
        if self.passed[tag]:
            self.passed[tag] -= 1
        else:
            self.close(tag)

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.raw.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_PARAGRAPH:
                self.close("p", PARAGRAPH_HOLDERS)
            elif tag in ("li", "option", "tr", "dt", "dd"):
                self.close(tag, ITEM_HOLDERS)
            elif tag in ("td", "th"):
                self.close("td", CELL_HOLDERS)
                self.close("th", CELL_HOLDERS)
        if tag in VOID or attributes.rstrip().endswith("/"):
            return
        if len(self.stack) >= DEEPEST:
            self.passed[tag] += 1
            return
        self.stack.append(Open(tag, attributes, self.stack[-1] if self.stack else None))
        self.held[tag] += 1

    def read(self, html: str) -> list[Block]:
        at, size = 0, len(html)
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self.take(html[at:])
                break
            ending = html.startswith("/", mark + 1)
            name = TAG_NAME.match(html, mark + 1 + ending)
            if name is None and not html.startswith(("!", "?", "/"), mark + 1):
                self.take(html[at : mark + 1])  # a mere sign
                at = mark + 1
                continue
            if mark > at:
                self.take(html[at:mark])
            if name is None:
                ends = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">"))
                at = next(past(html, e, mark + len(b)) for b, e in ends if html.startswith(b, mark))
                continue
            stop = tag_end(html, name.end())
            at = stop + 1
            if stop >= size:
                break
            tag = name[0].lower()
            if ending:
                self.end(tag)
            elif tag not in RAW:
                self.begin(tag, html[name.end() : stop])
            elif not (tag == "svg" and html[stop - 1] == "/"):
                found = end_of(tag).search(html, at)
                at = tag_end(html, found.end()) + 1 if found else size
        self.flush()
        return self.blocks


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order; white space inside is one space."""
    return Reader().read(html)


@lru_cache(maxsize=1 << 16)
def path_tokens(path: tuple[str, ...]) -> np.ndarray:
    vector = np.zeros(PATH_DIM, np.float32)
    for depth, name in enumerate(reversed(path)):
        for token in re.split("[-._]", name):
            vector[zlib.crc32(token.encode()) % PATH_DIM] += 1 / (1 + 0.3 * depth)
    return vector


@lru_cache(maxsize=200_000)
def word_place(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORD_DIM


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATH_DIM + WORD_DIM + 6), np.float32)
    for i, block in enumerate(page):
        words = block.text.split(" ")
        out[i, :PATH_DIM] = path_tokens(block.path)
        places = np.fromiter(map(word_place, words), np.int64, len(words))
        out[i, PATH_DIM:-6] = np.bincount(places, minlength=WORD_DIM) / len(words)
        figures = (np.log1p(len(words)) / 3, block.linked, i / len(page), len(page[i - 1].text.split(" ")) / (len(words) + 10.0) if i else 0, block.text[-1] in ".!?", min(block.depth, 64) / 8)
        out[i, -6:] = figures
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, width: int = PATH_DIM + WORD_DIM + 6, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        shape = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.weights = {f"{d}{k}": v for d in "fb" for k, v in (("x", shape(width, 4 * hidden)), ("h", shape(hidden, 4 * hidden)), ("c", np.zeros(4 * hidden, np.float32)))}
        for d in "fb":
            self.weights[f"{d}c"][hidden : 2 * hidden] = 1  # remember at first
        self.weights |= {"out": shape(2 * hidden, 1), "bias": np.zeros(1, np.float32)}

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time of x (time, page, feature) in one direction."""
        n, size = self.hidden, x.shape[1]
        h, c = np.zeros((size, n), np.float32), np.zeros((size, n), np.float32)
        gates_in = x @ self.weights[way + "x"] + self.weights[way + "c"]
        states, trace = np.zeros((len(x), size, n), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = gates_in[t] + h @ self.weights[way + "h"]
            i, f, o = sigmoid(g[:, :n]), sigmoid(g[:, n : 2 * n]), sigmoid(g[:, 2 * n : 3 * n])
            u = np.tanh(g[:, 3 * n :])
            m = mask[t][:, None]
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep:
                trace.append((t, h, c, i, f, o, u, tc))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            states[t] = h
        return states, trace

    def back(self, x: np.ndarray, mask: np.ndarray, way: str, trace: list, d_states: np.ndarray, grads: dict) -> None:
        n = self.hidden
        d_h, d_c = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
        for t, h, c, i, f, o, u, tc in reversed(trace):
            m = mask[t][:, None]
            total = (d_h + d_states[t]) * m
            rest_h, rest_c = (d_h + d_states[t]) * ~m, d_c * ~m
            cell = d_c * m + total * o * (1 - tc**2)
            g = np.concatenate((cell * u * i * (1 - i), cell * c * f * (1 - f), total * tc * o * (1 - o), cell * i * (1 - u**2)), axis=1)
            grads[way + "x"] += x[t].T @ g
            grads[way + "h"] += h.T @ g
            grads[way + "c"] += g.sum(0)
            d_h, d_c = g @ self.weights[way + "h"].T + rest_h, cell * f + rest_c

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page's blocks, pages of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):
            some = [order[k]]
            while k + len(some) < len(order) and (len(some) + 1) * len(pages[order[k + len(some)]]) <= TOGETHER:
                some.append(order[k + len(some)])
            k += len(some)
            x, mask = padded([pages[i] for i in some])
            states = np.concatenate((self.run(x, mask, "f", False)[0], self.run(x, mask, "b", False)[0]), axis=2)
            p = sigmoid(states @ self.weights["out"] + self.weights["bias"])[:, :, 0]
            for place, i in enumerate(some):
                out[i] = p[: len(pages[i]), place]
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                x, mask = padded([pages[i] for i in some])
                goal, weight = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
                for place, i in enumerate(some):
                    known = labels[i] >= 0
                    goal[: len(known), place], weight[: len(known), place] = labels[i] == 1, known
                runs = {way: self.run(x, mask, way, True) for way in "fb"}
                states = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
                p = sigmoid(states @ self.weights["out"] + self.weights["bias"])[:, :, 0]
                slope = ((p - goal) * weight / max(1, weight.sum()))[:, :, None]
                grads = {n: np.zeros_like(v) for n, v in self.weights.items()}
                grads["out"] += np.tensordot(states, slope, ((0, 1), (0, 1)))
                grads["bias"] += slope.sum()
                d_states = slope @ self.weights["out"].T
                for way, part in (("f", d_states[:, :, : self.hidden]), ("b", d_states[:, :, self.hidden :])):
                    self.back(x, mask, way, runs[way][1], part, grads)
                steps += 1
                for n, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    self.weights[n] -= RATE * (first[n] / (1 - 0.9**steps)) / (np.sqrt(second[n] / (1 - 0.99**steps)) + 1e-8)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for i, page in enumerate(pages):
        x[: len(page), i], mask[: len(page), i] = page, True
    return x, mask


def rebuilt(main: list[Block], pool: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A training page of the same article under other names, with other parts around it."""
    root = [("html", "body"), ("html", "body", "div.wrap"), ("html", "body", "div#page", "div.row")][rng.integers(3)]
    holder = [("article",), ("main",), ("div.content",), ("div.post",), ("div",), ("section.story",)][rng.integers(6)]
    pick = lambda: pool[rng.integers(len(pool))].text.split(" ")

    def part(path: tuple[str, ...], kind: str) -> list[Block]:
        if kind == "menu":
            return [Block((*root, *path), " ".join(pick()[:2]), 1.0) for _ in range(rng.integers(2, 9))]
        if kind == "comments":
            return [Block((*root, *path), " ".join(pick()[: rng.integers(5, 40)]), 0.0) for _ in range(rng.integers(1, 6))]
        return [Block((*root, *path), " ".join(pick()[: rng.integers(3, 18)]), 0.0) for _ in range(rng.integers(1, 3))]

    before = [b for k in rng.permutation(len(PARTS))[: rng.integers(0, 4)] for b in part(*PARTS[k])]
    after = [b for k in rng.permutation(len(AFTER))[: rng.integers(0, 4)] for b in part(*AFTER[k])]
    body = [Block((*root, *holder, b.path[-1].partition(".")[0] if b.path else "p"), b.text, b.linked) for b in main]
    inside: list[Block] = part(*PARTS[6 + rng.integers(2)]) if body and rng.random() < 0.2 else []
    inside = [Block((*root, *holder, *b.path[len(root) :]), b.text, b.linked) for b in inside]
    cut = int(rng.integers(1, len(body))) if inside and len(body) > 1 else len(body)
    all_ = [*before, *body[:cut], *inside, *body[cut:], *after]
    return all_, [0] * len(before) + [1] * cut + [0] * len(inside) + [1] * (len(body) - cut) + [0] * len(after)


def teaching(pages: DataFrame, id_col: str, html_col: str) -> list[list[Block]]:
    """Blocks of the bounded sample, page by page, in an order that reruns repeat."""
    source = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html")).filter("id is not null and html is not null")
    # The sample's ids are chosen first, without the pages; only the sample's blocks, one page an id, are collected.
    ids = source.select("id").distinct().withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(TRAIN_PAGES)
    sample = source.join(F.broadcast(ids), "id").groupBy("place", "id").agg(F.min("html").alias("html")).select("place", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, html in zip(batch.column("place").to_pylist(), batch.column("html"), strict=True):
                found = blocks(html.as_py())
                start = place % max(1, len(found) - TRAIN_BLOCKS + 1)
                rows = [(place, k, list(b.path), b.text[:BLOCK_CHARS], b.linked, b.label, b.depth) for k, b in enumerate(found[start : start + TRAIN_BLOCKS])]
                if rows:
                    types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["place", "k", "path", "text", "linked", "label", "depth"])

    read: dict[int, list[Block]] = {}
    found = sample.mapInArrow(run, "place bigint, k int, path array<string>, text string, linked double, label int, depth int").collect()
    for r in sorted(found, key=lambda r: (r["place"], r["k"])):
        read.setdefault(r["place"], []).append(Block(tuple(r["path"]), r["text"], r["linked"], r["label"], r["depth"]))
    return list(read.values())


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    read = teaching(pages, id_col, html_col)
    rng, labeller = np.random.default_rng(3), Labeller()
    vectors, labels = [], []
    pool = [b for page in read for b in page]
    marked = any(b.label == 1 for b in pool)
    for page in read:
        main = [b for b in page if (b.label == 1 if marked else b.label is None)]
        if not main:
            continue
        if marked:
            vectors.append(features(page))
            labels.append(np.array([-1 if b.label is None else b.label for b in page]))
        for _ in range(REBUILT):
            made, marks = rebuilt(main, pool, rng)
            if made:
                vectors.append(features(made))
                labels.append(np.array(marks))
    if vectors:
        labeller.train(vectors, labels)
    return labeller


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_blocks, n_kept."""
    labeller = labeller or fit(pages, id_col, html_col)
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), whole_text(pages[html_col]).alias("html"))
    id_type, url_type = (source.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            while k < batch.num_rows:
                begin, chars, read = k, 0, []
                while k < batch.num_rows and (k == begin or chars < 4_000_000):
                    html = batch.column("html")[k].as_py()
                    read.append(blocks(html))
                    chars += len(html)
                    k += 1
                rated = labeller.probabilities([features(p) for p in read])
                kept = [[b.text for b, p in zip(page, ps, strict=True) if p >= 0.5] for page, ps in zip(read, rated, strict=True)]
                texts = ["\n".join(x) for x in kept]
                columns = [batch.column(c).slice(begin, k - begin) for c in ("page_id", "url")]
                numbers = [[len(t) for t in texts], [len(p) for p in read], [len(x) for x in kept]]
                columns += [pa.array(texts, pa.string()), *[pa.array(n, pa.int64()) for n in numbers]]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return source.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
