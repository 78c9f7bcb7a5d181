"""Near-duplicate documents: Jaccard of word five-grams, found with a MinHash LSH forest and verified exactly.

1. Every text becomes its set of hashed five-grams. Documents with equal sets form one class, so
   copies never multiply. A class has ``trees * depth`` minima as its signature.
2. The forest has ``trees`` tries. A class's path in a tree is a sequence of ``DEEPEST`` of its minima:
   ``depth`` of the tree's own, then those of the trees that follow. Paths meet at the node of their
   first ``depth`` minima; below it they are sorted, and neighbours' common prefixes give the trie.
3. Matched prefixes are shortened level by level. At each level the pairs that newly share a node and
   are not tied yet are compared by whole signatures, and tied unless they are far below the threshold
   (five and a half standard errors). A trie whose classes are all tied needs no shorter prefix;
   the others go on until the recall at the threshold, 1 - (1 - t^level)^trees, reaches the target: that
   level is ``depth``, the longest prefix up to ``DEEPEST`` that does. What is skipped is tied already, so
   the recall is that of comparing all pairs of all nodes at ``depth``. Tied classes form candidate groups.
4. Inside a candidate group all pairs of classes are compared exactly, with their whole sets.

Large nodes and groups are cut into blocks; pairs of blocks are compared apart from each other,
so no task holds more than two blocks. Only counts and spanning edges leave a block, never pairs.

Edge cases: a null, empty or blank text has no five-grams and links with nothing; a text of one to
four words has its word sequence as its only gram; an empty table gives an empty result; rows that
share an id are judged by their own texts, rows without one as all others: classes have numbers of
their own, and ids only name the result (null if no row of a class has an id); very long texts use
all their grams.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.operators.components import connected_components
from edgewise.session import materialize, small_batches

MINIMA = 120
DEEPEST = 10
TARGET_RECALL = 0.9999
NODE_BLOCK = 512
GROUP_BLOCK = 256
#: Words whose hashes a worker keeps before it starts anew.
CACHE_WORDS = 200_000


def forest_shape(threshold: float, target: float = TARGET_RECALL, minima: int = MINIMA) -> tuple[int, int]:
    """(depth, trees): the longest prefix whose trees reach the target recall at the threshold."""
    for depth in range(DEEPEST, 0, -1):
        trees = minima // depth
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth, trees
    return 1, minima


@functools.lru_cache(maxsize=4)
def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    odd = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, count, dtype=np.uint64)


class Shingler:
    def __init__(self, size: int = 5):
        self.size = size
        self.known: dict[bytes, int] = {}

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of ``size`` words of a text."""
        import xxhash

        words = text.encode().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minima_of(grams: np.ndarray, count: int) -> np.ndarray:
    """The smallest of ``count`` pseudo-random functions over the grams, as 32-bit numbers."""
    a, b = _multipliers(count)
    best = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 2048):
        part = grams[None, at : at + 2048] * a[:, None]
        part += b[:, None]
        part >>= np.uint64(32)
        np.minimum(best, part.min(axis=1).astype(np.uint32), out=best)
    return best


def signatures(docs: DataFrame, depth: int, trees: int, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, text_md5, grams, digest, sig): one row a document; ``sig`` has two bytes of each minimum."""
    import xxhash

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size)
        for frame in frames:
            out = []
            for text in frame["text"]:
                g = shingler.grams(text)
                if not len(g):
                    out.append((0, b"", b""))
                    continue
                # The low halves: the high ones of minima are mostly zero.
                out.append((len(g), xxhash.xxh128_digest(g.tobytes()), minima_of(g, depth * trees).astype("<u2").tobytes()))
            signed = pd.DataFrame(out, columns=["grams", "digest", "sig"])
            yield pd.concat([frame[["doc_id", "known", "text_md5"]].reset_index(drop=True), signed], axis=1)

    # Null ids travel as 0 and a flag: pandas would turn the ids beside them into floats.
    key = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0).cast("long")).alias("doc_id"), key.isNotNull().alias("known"), F.md5(F.col(text_col)).alias("text_md5"), F.col(text_col).alias("text"))
    signed = rows.mapInPandas(run, "doc_id long, known boolean, text_md5 string, grams long, digest binary, sig binary")
    return signed.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "text_md5", "grams", "digest", "sig")


def grouped(frames: Iterator, keys: list[str]) -> Iterator:
    """Frames of one key each, from frames whose rows are sorted by key."""

    held, held_key = [], None
    for frame in frames:
        if not len(frame):
            continue
        changed = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = frame.iloc[a:b]
            key = tuple(part[k].iat[0] for k in keys) if a == 0 else None
            if a == 0 and key == held_key:
                held.append(part)
            else:
                if held:
                    yield pd.concat(held) if len(held) > 1 else held[0]
                held = [part]
        held_key = tuple(held[-1][k].iat[0] for k in keys)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def roots_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """By index: the smallest index in its component."""
    label = np.arange(n)
    if not len(pairs):
        return label
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)  # the old roots follow, so long chains close quickly
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tied_in_trie(paths: np.ndarray, sigs: np.ndarray, least: float, floor: int) -> np.ndarray:
    """Spanning pairs of the rows of one node, tied at the longest prefixes that they share, shortened down to ``floor``.

    ``paths`` are the rows' minima along the tree. Pairs are compared by signature at the level where they
    first share a node, unless they are tied by then.
    """
    order = np.lexsort(paths.T[::-1])
    sorted_paths, sorted_sigs = paths[order], sigs[order]
    common = np.cumprod(sorted_paths[1:] == sorted_paths[:-1], axis=1).sum(axis=1)  # with the row before
    near = (common >= floor) & ((sorted_sigs[1:] == sorted_sigs[:-1]).mean(axis=1) >= least)
    pairs = [np.stack([order[1:][near], order[:-1][near]], 1)]
    n = len(order)
    if near.all():
        return pairs[0]
    root = roots_of(n, np.stack([np.flatnonzero(near) + 1, np.flatnonzero(near)], 1))
    deeper = np.arange(n)  # nodes one level below
    for level in range(paths.shape[1], floor - 1, -1):
        node = np.concatenate([[0], np.cumsum(common < level)])
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            for i in range(a, b - 1):
                other = np.flatnonzero((root[i + 1 : b] != root[i]) & (deeper[i + 1 : b] != deeper[i])) + i + 1
                if not len(other):
                    continue
                hits = other[(sorted_sigs[other] == sorted_sigs[i]).mean(axis=1) >= least]
                for r in np.unique(root[hits]).tolist():
                    pairs.append(np.array([[order[i], order[hits[root[hits] == r][0]]]]))
                    low, high = min(r, root[i]), max(r, root[i])
                    root[root == high] = low
                    if not (root[a:b] != root[a]).any():
                        break
            if not root.any():
                return np.concatenate(pairs)
        deeper = node
    return np.concatenate(pairs)


def in_blocks(rows: DataFrame, key: str, id_col: str, count: str, most: int) -> DataFrame:
    """``rows`` with block_a and block_b: each row once for every pair of blocks that its own block is in.

    A group of up to ``most`` rows is one block; a larger one is cut by a hash of the id.
    """
    blocks = F.ceil(F.col(count) / most).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_col)), blocks.cast("long")).cast("int")
    placed = rows.withColumns({"blocks": blocks, "block": own})
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}).drop("other")


def candidate_groups(classes: DataFrame, least: float, depth: int, trees: int) -> DataFrame:
    """(id, component) of classes that have a candidate, from (rep, sig); ``rep`` is the number of a class."""

    own = lambda t: F.substring(F.col("sig"), t * (2 * depth) + 1, F.lit(2 * depth))
    # A node's address is a hash; that its rows share their minima is seen in the trie.
    places = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, own(t)))
    rows = classes.select("rep", F.posexplode(places).alias("tree", "node"))
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = rows.join(shared, "node").join(classes.select("rep", "sig"), "rep")
    dealt = in_blocks(met, "node", "rep", "members", NODE_BLOCK).select("node", "block_a", "block_b", "tree", "rep", "sig")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []
        for g in grouped(frames, ["node", "block_a", "block_b"]):
            ids = g["rep"].to_numpy()
            if len(ids) < 2:
                continue
            sigs = np.frombuffer(b"".join(g["sig"]), "<u2").reshape(len(ids), -1)
            along = (g["tree"].iat[0] * depth + np.arange(DEEPEST)) % sigs.shape[1]
            pairs = tied_in_trie(sigs[:, along], sigs, least, depth)
            if len(pairs):
                kept.append(ids[pairs])
            if len(kept) >= 5000:
                yield pd.DataFrame(np.unique(np.concatenate(kept), axis=0), columns=["src", "dst"])
                kept = []
        if kept:
            yield pd.DataFrame(np.unique(np.concatenate(kept), axis=0), columns=["src", "dst"])

    ordered = dealt.repartition("node", "block_a", "block_b").sortWithinPartitions("node", "block_a", "block_b")
    return connected_components(ordered.mapInPandas(run, "src long, dst long"))


def exact_links(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of sets with Jaccard at or above the threshold; with two sides, only pairs across them."""
    sizes = np.asarray([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a gram of one set meets no other
    owner, column = owner[shared], column[shared]
    if not len(column):
        return np.empty((0, 2), int)
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (common >= threshold * union - 1e-6) & np.triu(np.ones(common.shape, bool), 1)
    if side.any():
        linked &= side[:, None] != side[None, :]
    return np.argwhere(linked)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs``.

    ``class_id`` is the smallest id reachable over links (nulls aside), ``n_links`` the number of other
    rows at or above the threshold, copies included.
    """

    depth, trees = forest_shape(threshold)
    with small_batches(docs.sparkSession):
        signed = materialize(signatures(docs, depth, trees, id_col, text_col, size))
    classes = signed.filter("grams > 0").groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_md5")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")
    )
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    least = threshold - 5.5 * (threshold * (1 - threshold) / (depth * trees)) ** 0.5
    groups = materialize(candidate_groups(classes, least, depth, trees))
    members = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = groups.join(members, "component").withColumnRenamed("id", "rep").join(classes.select("rep", "at", "copies"), "rep")
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col)).alias("text_md5"), F.col(text_col).alias("text"))
    texts = row.join(placed, F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("text_md5") == F.col("at.text_md5"))).dropDuplicates(["rep"])
    dealt = in_blocks(texts, "component", "rep", "members", GROUP_BLOCK)
    dealt = dealt.select("component", "block_a", "block_b", "blocks", "block", "rep", "copies", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, out = Shingler(size), []
        for g in grouped(frames, ["component", "block_a", "block_b"]):
            g = g.sort_values("rep")
            ids, copies = g["rep"].to_numpy(), g["copies"].to_numpy()
            a, b = g["block_a"].iat[0], g["block_b"].iat[0]
            side = (g["block"].to_numpy() != a) if a != b else np.zeros(len(ids), bool)
            if len(ids) < 2:
                continue
            pairs = exact_links([shingler.grams(t) for t in g["text"]], side, threshold)
            links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(ids))
            root = roots_of(len(ids), pairs)
            has = links > 0
            if has.any():
                out.append(pd.DataFrame({"rep": ids[has], "links": links[has].astype(np.int64), "root": ids[root[has]], "parted": bool(g["blocks"].iat[0] > 1)}))
            if len(out) >= 1000:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    ordered = dealt.repartition("component", "block_a", "block_b").sortWithinPartitions("component", "block_a", "block_b")
    with small_batches(docs.sparkSession):
        found = materialize(ordered.mapInPandas(run, "rep long, links long, root long, parted boolean"))
    # A group of one block has its classes already; those of several blocks are joined over all their parts.
    parted = connected_components(found.filter("parted").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    whole = found.filter("NOT parted").select("rep", F.col("root").alias("class"))
    class_of = whole.unionByName(parted.select(F.col("id").alias("rep"), F.col("component").alias("class")))
    lowest = class_of.join(classes.select("rep", "low"), "rep").groupBy("class").agg(F.min("low").alias("class_low"))
    named = class_of.join(lowest, "class").select("rep", "class_low")
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).join(named, "rep")
    by_digest = classes.select("digest", "rep", "low", "copies").join(links, "rep", "left").select(
        "digest", F.coalesce("class_low", "low").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    by_digest = materialize(by_digest)  # so that both sides are plain exchanges, and the copies of one text can be dealt to several tasks
    with_grams = signed.filter("grams > 0").select("doc_id", "digest").join(by_digest, "digest").select("doc_id", "class_id", "n_links")
    without = signed.filter("grams = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_grams.unionByName(without)


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)


#: All pairs that share a five-gram, counted by the grams that they share.
OP10_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
class(id, low) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.b, min(c.low) FROM class c JOIN links l ON l.a = c.id JOIN recurring.class k ON k.id = l.b WHERE c.low < k.low GROUP BY l.b),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS doc_id, low AS class_id, coalesce(n, 0)::BIGINT AS n_links FROM class LEFT JOIN counts ON a = id
"""

QUERIES = {"op10_ngram_join": op10_query}
SQL = {"op10_ngram_join": OP10_SQL}
