"""Main text of web pages, by a recurrent labeller of leaf blocks.

A page becomes the sequence of its leaf blocks. Each block is described by hashed vectors of the
elements on its tag path, hashed vectors of its words, and a few numbers (length, links, place). A
bidirectional LSTM in numpy reads the sequence both ways and gives each block the chance of being
main text, so a decision uses the whole page. The blocks with a chance of a half or more are joined
by one newline.

There are no labelled pages, so the network is trained on pages made by ``made_page``: layouts drawn
at random, with and without semantic elements, in invented words, whose blocks carry their label.
The number of pages is a parameter; training takes seconds on the driver and its seed is fixed.

Edge cases: null or empty markup gives an empty text; a page without main text too; very long pages
are read as one sequence; malformed markup is read the way browsers do, see ``html_blocks``; repeated
pages have equal texts; an empty table gives an empty result; other columns pass through whatever their
names, a column named as the text's is replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.html_blocks import Block, blocks_of

PATHS, WORDS = 1 << 12, 1 << 11  # buckets of the hashed vectors
PATH_SIZE, WORD_SIZE, NUMBERS, HIDDEN = 20, 6, 8, 20
#: Made pages that the network is trained on, and passes over them.
TRAIN_PAGES, PASSES, BATCH = 1200, 6, 24
CACHE = 300_000

word_parts = re.compile(r"\w+|©").findall


def bucket(text: str, count: int) -> int:
    return zlib.crc32(text.encode()) % count


# --- pages made for training ---------------------------------------------------------------------

#: Class and id words that sites use for parts of a page.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav sitenav tabs toc links pager pagination".split(),
    "header": "header masthead topbar banner branding logo sitehead hero".split(),
    "footer": "footer bottom colophon copyright legal sitefoot credits imprint".split(),
    "sidebar": "sidebar aside rail widget related trending popular recommended tags share social newsletter archive".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay subscribe paywall disclaimer warning message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox adsense teaser partner".split(),
    "form": "form search login signup contact register searchform field".split(),
    "comments": "comment comments reply respond discussion disqus thread feedback reader commentlist".split(),
    "main": "content article post entry story main body text page single prose copy".split(),
}
SAID = {
    "menu": "home about contact news sports blog archive next previous more".split(),
    "header": "welcome official site search menu".split(),
    "footer": "© copyright all rights reserved terms privacy 2024".split(),
    "sidebar": "related popular trending share follow latest posts".split(),
    "notice": "cookies accept privacy we use consent subscribe notice".split(),
    "ad": "sponsored advertisement buy now offer sale free".split(),
    "form": "search submit email password name login send".split(),
    "comments": "reply says comments said ago posted comment".split(),
    "main": ["the"],
}


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """Markup of a random page, and for each of its leaf blocks whether it is main text."""
    parts = ["".join(rng.choice("bcdfghlmnprstvwzéöñ") + rng.choice("aeiouy") + rng.choice(["", "n", "r", "st"]) for _ in range(1)) for _ in range(40)]
    out: list[str] = []
    labels: list[bool] = []

    def words(n: int, kind: str, own: float) -> str:
        said = [rng.choice(SAID[kind]) if rng.random() < own else "".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
        text = " ".join(w + ("." if rng.random() < 0.12 else "," if rng.random() < 0.05 else "") for w in said)
        return text[:1].upper() + text[1:]

    def leaf(tag: str, text: str, main: bool, link: bool = False, closed: bool = True) -> None:
        labels.append(main)
        text = f'<a href="/x">{text}</a>' if link else text
        if main and rng.random() < 0.15:
            text = f"<b>{text}" + ("</b>" if rng.random() < 0.5 else "<br>")
        out.append(f"<{tag}>{text}" + (f"</{tag}>" if closed else ""))

    def opened(kind: str, semantic: str | None, chance: float) -> str:
        tag = semantic if semantic and rng.random() < chance else rng.choice(["div", "div", "section"])
        named = tag in ("div", "section") or rng.random() < 0.4
        word = rng.choice(NAMES[kind])
        extra = rng.choice(["", "-wrap", "-box", "-area", " block", "_list", ""])
        out.append(f'<{tag} {rng.choice(["class", "class", "id"])}="{word}{extra}">' if named else f"<{tag}>")
        return f"</{tag}>"

    def junk(kind: str) -> None:
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        own = rng.choice([0.0, 0.0, 0.15, 0.5])
        end = opened(kind, semantic, 0.75)
        if kind == "menu" or kind == "sidebar" and rng.random() < 0.6:
            if rng.random() < 0.75:
                out.append("<ul>")
                for _ in range(rng.randint(2, 9)):
                    leaf("li", words(rng.randint(1, 4 if kind == "menu" else 9), kind, own), False, rng.random() < 0.9)
                out.append("</ul>")
            else:
                leaf("p", words(rng.randint(2, 12), kind, own), False, True)
        elif kind == "comments":
            if rng.random() < 0.6:
                leaf(rng.choice(["h2", "h3"]), words(rng.randint(1, 4), kind, own), False)
            for _ in range(rng.randint(1, 5)):
                out.append(rng.choice(['<div class="comment">', "<li>", "<div>"]))
                close = "</div>" if out[-1].startswith("<div") else "</li>"
                for _ in range(rng.randint(1, 2)):
                    leaf("p", words(rng.randint(2, 60), kind, own), False)
                out.append(close)
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                leaf(rng.choice(["label", "button", "p", "legend"]), words(rng.randint(1, 8), kind, own), False)
        else:
            text = words(rng.randint(1, 45), kind, own)
            if rng.random() < 0.5:
                labels.append(False)
                out.append(("&copy; " if kind == "footer" and rng.random() < 0.6 else "") + text)
            else:
                for _ in range(rng.randint(1, 3)):
                    leaf(rng.choice(["p", "p", "div", "h2", "h4"]), words(rng.randint(1, 35), kind, own), False, rng.random() < 0.2)
        out.append(end)

    def article() -> None:
        end = opened("main", rng.choice(["article", "article", "main"]), 0.7)
        inner = opened("main", None, 0) if rng.random() < 0.25 else ""
        if rng.random() < 0.85:
            head = rng.random() < 0.15
            out.append("<header>" if head else "")
            leaf(rng.choice(["h1", "h1", "h2"]), words(rng.randint(1, 14), "main", 0), True)
            out.append("</header>" if head else "")
        for k in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            r = rng.random()
            if r < 0.07:
                leaf(rng.choice(["h2", "h3"]), words(rng.randint(1, 7), "main", 0), True)
            elif r < 0.14:
                out.append(listed := rng.choice(["<ul>", "<ol>", "<blockquote>"]))
                for _ in range(rng.randint(1, 5)):
                    leaf("p" if listed == "<blockquote>" else "li", words(rng.randint(2, 25), "main", 0), True, rng.random() < 0.1)
                out.append(listed.replace("<", "</"))
            elif r < 0.19 and k:
                junk(rng.choice(["ad", "sidebar", "notice", "form"]))
            else:
                leaf("p", words(rng.choice([2, 5, 12, 30, 60, 110, 160]), "main", 0), True, rng.random() < 0.02, rng.random() < 0.93)
        if rng.random() < 0.15:
            junk(rng.choice(["comments", "sidebar"]))
        out.append(inner)
        out.append(end)

    out.append("<!DOCTYPE html><html><head><title>")
    labels.append(False)
    out.append(words(rng.randint(1, 14), "main", 0) + "</title></head><body>")
    wrapped = rng.random() < 0.3
    out.append('<div id="wrapper">' if wrapped else "")
    for kind in rng.sample(["header", "menu", "ad", "notice", "form", "menu", "sidebar"], rng.randint(1, 4)):
        junk(kind)
    article()
    for kind in rng.sample(["footer", "footer", "comments", "sidebar", "ad", "notice", "menu", "form"], rng.randint(0, 4)):
        junk(kind)
    out.append("</div>" if wrapped else "")
    return "".join(out) + rng.choice(["</body></html>", ""]), labels


# --- the network ---------------------------------------------------------------------------------


class Features:
    """Blocks to bucket numbers, with bounded caches."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], list[int]] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> list[int]:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > CACHE:
                self.paths.clear()
            tokens = [f"{w}" for said in path for w in said.split()]
            tokens += [f"last:{path[-1]}" if path else "last:", f"tags:{'>'.join(said.split()[0] for said in path[-3:])}"]
            got = self.paths[path] = sorted({bucket(t, PATHS) for t in tokens})
        return got

    def page(self, blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        words, paths, bags = self.words, [], []
        numbers = np.empty((len(blocks), NUMBERS))
        if len(words) > CACHE:
            words.clear()
        for k, b in enumerate(blocks):
            found = word_parts(b.text)
            for w in set(found).difference(words):
                words[w] = bucket(w.lower(), WORDS)
            paths.append(self.path(b.path))
            bags.append([words[w] for w in found] or [0])
            n = len(found)
            numbers[k] = (np.log1p(n) / 3 - 1, b.linked, k / len(blocks), len(b.path) / 6, n < 4, n > 20, b.text[-1:] in ".!?", 1)
        return paths, bags, numbers


def bag_means(table: np.ndarray, bags: list[list[int]]) -> np.ndarray:
    sizes = np.asarray([len(b) for b in bags])
    flat = np.fromiter((i for b in bags for i in b), np.int64, int(sizes.sum()))
    return np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = PATH_SIZE + WORD_SIZE + NUMBERS
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"paths": rng.normal(0, 0.3, (PATHS, PATH_SIZE)), "words": rng.normal(0, 0.1, (WORDS, WORD_SIZE))}
    for d in ("ahead", "back"):
        w |= {f"{d}_x": draw(size, 4 * HIDDEN), f"{d}_h": draw(HIDDEN, 4 * HIDDEN), f"{d}_b": np.zeros(4 * HIDDEN)}
    return w | {"out": draw(2 * HIDDEN + size, 1), "out_b": np.zeros(1)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of shape (time, batch, HIDDEN); x is (time, batch, size). Gate order: in, forget, out, new."""
    inputs = x @ wx + b
    h, c = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
    out = np.empty((*x.shape[:2], HIDDEN))
    for t in range(len(x)):
        z = inputs[t] + h @ wh
        gates, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[t][:, None]
        c_new = f * c + i * new
        squashed = np.tanh(c_new)
        if keep is not None:
            keep.append((h, c, i, f, o, new, squashed, m))
        h, c = m * (o * squashed) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out


def lstm_back(grad: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of x, wx, wh and b."""
    dz_all = np.empty((*x.shape[:2], 4 * HIDDEN))
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    dwh = np.zeros_like(wh)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, new, squashed, m = kept[t]
        dh = dh + grad[t]
        inner = m * dh
        dc_new = m * dc + inner * o * (1 - squashed**2)
        dz = np.concatenate([dc_new * new * i * (1 - i), dc_new * c * f * (1 - f), inner * squashed * o * (1 - o), dc_new * i * (1 - new**2)], 1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh = (1 - m) * dh + dz @ wh.T
        dc = (1 - m) * dc + dc_new * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return dz_all @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of shape (time, batch). Padding is at the end, so the backward reader starts inside it, masked."""
    a, b = ([], []) if keep is not None else (None, None)
    ahead = lstm(x, mask, w["ahead_x"], w["ahead_h"], w["ahead_b"], a)
    back = lstm(x[::-1], mask[::-1], w["back_x"], w["back_h"], w["back_b"], b)[::-1]
    joined = np.concatenate([ahead, back, x], 2)
    if keep is not None:
        keep |= {"a": a, "b": b, "joined": joined}
    return (joined @ w["out"])[:, :, 0] + w["out_b"][0]


def padded(pages: list[tuple], w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[int]]]:
    """(x, mask, all path bags, all word bags) of pages as (path bags, word bags, numbers)."""
    paths, bags = [p for page in pages for p in page[0]], [b for page in pages for b in page[1]]
    each = np.concatenate([bag_means(w["paths"], paths), bag_means(w["words"], bags), np.concatenate([page[2] for page in pages])], 1)
    longest = max(len(page[0]) for page in pages)
    x, mask = np.zeros((longest, len(pages), each.shape[1])), np.zeros((longest, len(pages)))
    at = 0
    for k, page in enumerate(pages):
        n = len(page[0])
        x[:n, k], mask[:n, k] = each[at : at + n], 1
        at += n
    return x, mask, paths, bags


def train(pages: int = TRAIN_PAGES, passes: int = PASSES, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights, fitted to made pages by Adam with back-propagation through time."""
    rng, features = random.Random(seed), Features()
    made = []
    while len(made) < pages:
        markup, labels = made_page(rng)
        blocks = blocks_of(markup)
        if len(blocks) == len(labels):
            made.append((*features.page(blocks), np.asarray(labels, float)))
    w = start(seed)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for turn in range(passes):
        order = list(range(pages))
        rng.shuffle(order)
        for at in range(0, pages, BATCH):
            batch = sorted((made[k] for k in order[at : at + BATCH]), key=lambda p: len(p[0]))
            x, mask, paths, bags = padded(batch, w)
            y = np.zeros_like(mask)
            for k, p in enumerate(batch):
                y[: len(p[3]), k] = p[3]
            keep: dict = {}
            d = (sigmoid(forward(w, x, mask, keep)) - y) * mask / mask.sum()
            g = {"out": np.einsum("tbi,tb->i", keep["joined"], d)[:, None], "out_b": np.array([d.sum()])}
            dj = d[:, :, None] * w["out"][:, 0]
            dx1, g["ahead_x"], g["ahead_h"], g["ahead_b"] = lstm_back(dj[:, :, :HIDDEN], x, w["ahead_x"], w["ahead_h"], keep["a"])
            dx2, g["back_x"], g["back_h"], g["back_b"] = lstm_back(dj[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], w["back_x"], w["back_h"], keep["b"])
            dx = dx1 + dx2[::-1] + dj[:, :, 2 * HIDDEN :]
            each = np.concatenate([dx[: len(p[0]), k] for k, p in enumerate(batch)])
            for name, found, part in (("paths", paths, each[:, :PATH_SIZE]), ("words", bags, each[:, PATH_SIZE : PATH_SIZE + WORD_SIZE])):
                sizes = np.asarray([len(f) for f in found])
                g[name] = np.zeros_like(w[name])
                np.add.at(g[name], np.fromiter((i for f in found for i in f), np.int64), np.repeat(part / sizes[:, None], sizes, axis=0))
            step += 1
            rate = 0.01 * (1 - 0.8 * turn / passes)
            for k, v in w.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return w


class Extractor:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w, self.features = weights, Features()

    def chances(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """By page, each block's chance of being main text; pages of like lengths are read together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            x, mask, _, _ = padded([self.features.page(pages[k]) for k in part], self.w)
            p = sigmoid(forward(self.w, x, mask))
            for b, k in enumerate(part):
                out[k] = p[: len(pages[k]), b]
        return out

    def texts(self, pages: list[str | None]) -> list[str]:
        found = [blocks_of(p) for p in pages]
        return ["\n".join(b.text for b, c in zip(blocks, p, strict=True) if c >= 0.5) for blocks, p in zip(found, self.chances(found), strict=True)]


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``pages`` with the main text of each."""
    sent = pages.sparkSession.sparkContext.broadcast(train(train_pages))

    @F.pandas_udf("string")
    def main(markup: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extractor = Extractor(sent.value)
        for s in markup:
            rows = s.tolist()
            yield pd.Series([t for at in range(0, len(rows), 512) for t in extractor.texts(rows[at : at + 512])], dtype=object)

    return pages.withColumn(text_col, main(F.col(html_col)))


def op4_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html": op4_query}
#: No SQL: the labeller is trained; tests/llm/test_text_operators.py holds it against pages whose main text is known.
SQL: dict[str, str] = {}
