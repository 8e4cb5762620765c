"""HTML main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each with the path of tags and class words above it. Every block turns into
a vector: hashed path tokens and hashed words through embedding tables, and a few measures (length, link share,
punctuation, position). A bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or
not, so a block is judged in the context of its document. It is trained here, on the driver, from seeded synthetic
pages whose blocks have known labels; the weights are small and of fixed size.

Defined cases: null or empty html gives empty text; unclosed tags, scripts and comments end with the page; very long pages
are read whole, in time in proportion to their length; rows that repeat are extracted alike; extra columns are ignored; an empty table gives an empty result; pages without main blocks give empty text.
"""

from __future__ import annotations

import functools
import html as entities
import math
import pickle
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PADDED = 1 << 14
PATH_IDS, WORD_IDS, DIM, HIDDEN, MEASURES = 1024, 512, 16, 20, 8
SCHEMA = "page_id long, url string, text string, n_chars long"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>\"[^\"]*\"|'[^']*'|[^>\"']++|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags that have no content, and tags that stay inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ALONE = frozenset(("p", "li", "td", "th", "tr", "dt", "dd", "option"))


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: list[str], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: list[str] = []
    linked = links = at = 0

    def text(raw: str) -> None:
        nonlocal path, linked
        if raw:
            if not path and not raw.isspace():
                path = [t for _, tokens in stack for t in tokens]
            parts.append(raw)
            if links:
                linked += len(raw)

    def flush() -> None:
        nonlocal path, linked
        if parts:
            said = " ".join(entities.unescape("".join(parts)).split())
            if said:
                out.append(Block(path, said, linked))
            parts.clear()
        path, linked = [], 0

    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(s[0] == "a" for s in stack[i:])
                    del stack[i:]
                    break
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag in ALONE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        links -= sum(s[0] == "a" for s in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            words = [w for a in _ATTR.finditer(m[4]) for w in re.split(r"[^a-zA-Z]+", a[2] or a[3] or a[4] or "") if w] if "=" in m[4] else []
            stack.append((tag, (f"<{tag}", *(f".{w.lower()}" for w in words))))
            links += tag == "a"
    text(page[at:])
    flush()
    return out


@functools.lru_cache(20_000)
def _path_ids(path: tuple[str, ...]) -> list[int]:
    return sorted({zlib.crc32(t.encode()) % PATH_IDS for t in path} | ({zlib.crc32(b"leaf" + path[-1].encode()) % PATH_IDS} if path else set()))


@functools.lru_cache(200_000)
def _word_id(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_IDS


def encode_page(blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Path ids, word ids and measures of each block."""
    paths = [_path_ids(tuple(b.path)) for b in blocks]
    words = [[_word_id(w) for w in b.text.split()] for b in blocks]
    n = max(1, len(blocks))
    rows = []
    for i, b in enumerate(blocks):
        size = len(b.text)
        rows.append((min(8.0, math.log1p(size)) / 4, min(1.0, b.linked / size), min(1.0, 8 * (b.text.count('.') + b.text.count(',')) / size), i / n, (n - i) / n, float(size < 40), float("©" in b.text), 1.0))
    return paths, words, np.array(rows, np.float32).reshape(-1, MEASURES)


class Labeller:
    """Bidirectional LSTM over blocks; plain numpy, forward and backward."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = 2 * DIM + MEASURES
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"path": f(PATH_IDS, DIM) * 8, "word": f(WORD_IDS, DIM) * 4, "out": f(2 * HIDDEN + n, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": f(n, 4 * HIDDEN), f"h{d}": f(HIDDEN, 4 * HIDDEN), f"c{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages, n) inputs and (steps, pages) mask."""
        steps = max(len(p[2]) for p in pages)
        x = np.zeros((steps, len(pages), 2 * DIM + MEASURES), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for j, (paths, words, measures) in enumerate(pages):
            k = len(measures)
            for table, lists, lo in (("path", paths, 0), ("word", words, DIM)):
                sizes = np.array([len(v) for v in lists])
                if sizes.sum():
                    flat = self.w[table][np.concatenate([np.asarray(v, np.int64) for v in lists])]
                    full = np.nonzero(sizes)[0]
                    sums = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), axis=0)
                    x[full, j, lo : lo + DIM] = sums / (np.sqrt(sizes[full]) if table == "path" else sizes[full])[:, None]
            x[:k, j, 2 * DIM :] = measures
            mask[:k, j] = 1
        return x, mask

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Outputs of one direction and, if kept for training, what each step held."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        xs = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        out, memo = np.zeros((steps, pages, HIDDEN), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = xs[t] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = (f * c + i * g) * m
            th = np.tanh(new)
            memo[t] = (h, c, i, f, o, g, th, m) if keep else None
            h, c = o * th * m, new
            out[t] = h
        return out, memo

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        a, ma = self.run(x, mask, "f", keep)
        b, mb = self.run(x, mask, "b", keep)
        top = np.concatenate([a, b, x], axis=2)
        return (top @ self.w["out"])[:, :, 0] + self.w["bias"][0], (top, ma, mb)

    def gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = self.inputs(pages)
        y = np.zeros_like(mask)
        for j, v in enumerate(labels):
            y[: len(v), j] = v
        z, (top, ma, mb) = self.forward(x, mask)
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"out": np.einsum("tpk,tp->k", top, dz)[:, None], "bias": np.array([dz.sum()])}
        dtop = dz[:, :, None] * self.w["out"][:, 0]
        dx = dtop[:, :, 2 * HIDDEN :].copy()
        for d, memo, lo in (("f", ma, 0), ("b", mb, HIDDEN)):
            steps = len(memo)
            dh, dc = np.zeros_like(memo[0][0]), np.zeros_like(memo[0][1])
            gx, gh, gc = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"h{d}"]), np.zeros_like(self.w[f"c{d}"])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, c, i, f, o, gg, th, m = memo[t]
                dh = (dh + dtop[t, :, lo : lo + HIDDEN]) * m
                dc = dc + dh * o * (1 - th * th)
                dc = dc * m
                dzt = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                gx += x[t].T @ dzt
                gh += h.T @ dzt
                gc += dzt.sum(0)
                dx[t] += dzt @ self.w[f"x{d}"].T
                dh, dc = dzt @ self.w[f"h{d}"].T, dc * f
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        gp, gw = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for j, (paths, words, _) in enumerate(pages):
            for t, (p, w) in enumerate(zip(paths, words, strict=True)):
                if p:
                    gp[p] += dx[t, j, :DIM] / np.sqrt(len(p))
                if w:
                    np.add.at(gw, w, dx[t, j, DIM : 2 * DIM] / len(w))
        return g | {"path": gp, "word": gw}

    def label(self, pages: list) -> list[np.ndarray]:
        """True for main blocks, for pages of any number of blocks."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        some = sorted((i for i, p in enumerate(pages) if len(p[2])), key=lambda i: len(pages[i][2]))
        while some:
            # pages of like length together, as many as PADDED blocks hold at the longest one's length
            count = 1
            while count < min(len(some), 128) and len(pages[some[-1]][2]) * (count + 1) <= PADDED:
                count += 1
            part, some = some[-count:], some[:-count]
            z, _ = self.forward(*self.inputs([pages[i] for i in part]), keep=False)
            for j, i in enumerate(part):
                out[i] = z[: len(pages[i][2]), j] > 0
        return out


#: Words that name boilerplate and main regions in classes of the synthetic pages.
OUTSIDE = "ad ads advert advertisement sponsor promo sidebar side widget comment comments reply respond discussion cookie consent gdpr notice alert banner popup modal menu nav navbar navigation breadcrumb header masthead topbar footer bottom copyright legal share social related recommended newsletter subscribe signup login search form tags meta pagination skip toolbar".split()
INSIDE = "content main article post entry story body text page wrapper container prose section markdown".split()

#: Layout words of classes, as utility style sheets have them; they say nothing of a block.
LAYOUT = "mt-4 mb-2 mx-auto px-2 py-3 p-4 text-sm text-lg font-bold flex items-center justify-between grid gap-4 col-6 row w-full h-64 max-w-xl bg-white border rounded shadow hidden md:block lg:flex relative absolute top-0 z-10 overflow-auto float-left leading-6 space-y-2".split()


def synthetic_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its blocks in order; some classes stand among layout words."""
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "re", "in", "ou", "ti", "é", "ü", "sch", "la", "ci")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=60: words(a, b).capitalize() + "."
    labels: list[int] = []

    def say(label: int, text: str) -> str:
        labels.append(label)
        return text

    def attrs(pool: list[str]) -> str:
        names = r.sample(pool, 1) + ([word()] if r.random() < 0.2 else [])
        if r.random() < 0.3:
            names = r.sample(LAYOUT, r.randint(1, 10)) + names
            if r.random() < 0.3:
                r.shuffle(names)
        return f' {r.choice(("class", "class", "id"))}="{" ".join(names)}"'

    def outside(sort: str) -> str:
        if sort == "nav":
            return f"<nav{r.choice(['', attrs(OUTSIDE)])}><ul>" + "".join(f'<li><a href="/{i}">{say(0, words(1, 2))}</a></li>' for i in range(r.randint(2, 8))) + "</ul></nav>"
        if sort == "header":
            return f"<header>{r.choice(['<h1>', '<div>'])}{say(0, words(1, 5))}</header>"
        if sort == "footer":
            return f"<footer{r.choice(['', attrs(OUTSIDE)])}>{say(0, r.choice(['&copy; ', '']) + words(2, 12))}</footer>"
        if sort == "aside":
            return f"<aside{r.choice(['', attrs(OUTSIDE)])}>" + "".join(f"<{t}>{say(0, sentence(2, 30))}</{t}>" for t in r.choices(("p", "li", "h3", "div"), k=r.randint(1, 4))) + "</aside>"
        if sort == "form":
            return f"<form><label>{say(0, words(1, 4))}</label><input><div>{say(0, words(1, 3))}</div></form>"
        tag = r.choice(("div", "div", "section", "ul"))
        inner = r.choice(("p", "div", "li", "")) if tag != "ul" else "li"
        body = "".join((f"<{inner}>" if inner else "") + say(0, sentence(2, 40)) + (f"</{inner}>" if inner else "") for _ in range(r.randint(1, 5) if inner else 1))
        return f"<{tag}{attrs(OUTSIDE)}>{body}</{tag}>"

    def inside() -> str:
        parts = []
        if r.random() < 0.85:
            parts.append(f"<h1>{say(1, words(2, 10))}</h1>")
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.62:
                parts.append(f"<p>{say(1, sentence(1, 4) if r.random() < 0.25 else sentence(2, 120))}</p>")
            elif kind < 0.70:
                parts.append(f"<p><b>{say(1, sentence(1, 12))}<br>")
            elif kind < 0.78:
                parts.append(f"<h{(k := r.randint(2, 4))}>{say(1, words(1, 6))}</h{k}>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{say(1, words(2, 14))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote>{say(1, sentence(5, 40))}</blockquote>")
            elif kind < 0.91:
                parts.append(f"<pre>{say(1, words(3, 20))}</pre>")
            elif kind < 0.94:
                parts.append("<table><tr>" + "".join(f"<td>{say(1, words(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                parts.append(outside("box"))
            else:
                parts.append(f'<p><a href="#">{say(1, sentence(3, 20))}</a></p>')
        return "".join(parts)

    page = "<!DOCTYPE html><html><head><title>x</title></head><body>"
    wrap = r.random() < 0.25
    page += f"<div{attrs(INSIDE)}>" if wrap else ""
    for sort in r.choices(("nav", "header", "box", "box", "form"), k=r.randint(0, 4)):
        page += outside(sort)
    opening, closing = r.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), (f"<div{attrs(INSIDE)}>", "</div>"), (f"<article{attrs(INSIDE)}>", "</article>"), ("<main><article>", "</article></main>")))
    page += opening + inside() + closing
    for sort in r.choices(("box", "aside", "box", "nav", "form"), k=r.randint(0, 4)):
        page += outside(sort)
    if r.random() < 0.8:
        page += outside("footer")
    page += "</div>" if wrap else ""
    return page + ("</body></html>" if r.random() < 0.9 else ""), labels


def train(pages: int = 450, epochs: int = 6, seed: int = 3, rate: float = 0.012) -> Labeller:
    r, model = random.Random(seed), Labeller()
    data = []
    for _ in range(pages):
        page, labels = synthetic_page(r)
        found = blocks_of(page)
        if len(found) == len(labels):
            data.append((encode_page(found), np.array(labels, np.float32)))
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    t = 0
    for _ in range(epochs):
        r.shuffle(data)
        for k in range(0, len(data), 16):
            part = sorted(data[k : k + 16], key=lambda d: len(d[1]))
            t += 1
            for key, g in model.gradients([d[0] for d in part], [d[1] for d in part]).items():
                m[key] = 0.9 * m[key] + 0.1 * g
                v2[key] = 0.99 * v2[key] + 0.01 * g * g
                model.w[key] = (model.w[key] - rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(v2[key] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return model


def extract_pages(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, main text and its code points."""
    packed = pickle.dumps((model or train()).w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.w = pickle.loads(packed)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                found = [blocks_of(h or "") for h in b.column("html").to_pylist()]
                marks = labeller.label([encode_page(f) for f in found])
                texts = ["\n\n".join(x.text for x, keep in zip(f, k, strict=True) if keep) for f, k in zip(found, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
