"""Exact removal of repeated passages, by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a document with a smaller
id. Which strings repeat is read off the repeated intervals of merged transforms:

1. Suffixes are dealt to tasks by content. A window's key is the smallest hash of the ``GRAM``-byte grams
   inside it, so windows of equal content meet, and as neighbours mostly share their key a text falls
   into fragments of one key, each with all the bytes of its windows. Keys of one text only have
   nothing to meet and are left out; that takes one exchange of packed keys.
2. Equal texts, and then equal fragments, are folded into one with its smallest document id.
3. In a task, fragments form shards. Each shard is suffix-sorted once and gives its transform. The
   transforms are merged by refining their interleave: starting from the order by no byte at all,
   each round reorders by the word before with a stable counting sort of the transforms' symbols.
   Where a border first appears, the common prefix ends: the round gives its words, the two words that
   differ give the bytes. No suffix is sorted again. Repeated intervals are the runs of suffixes whose
   common prefixes reach ``WINDOW``.
4. The smallest id of each interval decides about its windows; spans go back to the documents.

A task of the merge holds about ``MERGE_BYTES``. A key with more than ``HOT_BYTES`` of different
contexts is not merged in one task: the windows of its fragments are grouped by a 128-bit hash,
with partial aggregation, which decides the same. Texts go in pieces of ``PIECE`` bytes, so memory does
not follow the longest text. Groups of texts follow the bytes of the input; the packed keys of
a group are one row for each part of the key space that has any, never more rows than keys.

Edge cases: a null text is empty; texts under ``WINDOW`` bytes lose nothing; a null id counts as
larger than all others; rows with one id never remove each other's bytes; zero bytes are ordinary;
long runs of one byte form one long fragment; an empty table gives an empty result; columns of the
input other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.session import Scratch, stored

WINDOW = 50
GRAM = 24
WORD = 8
#: Bytes of text in a group whose fragments are cut together, and for each part of the key space.
GROUP_BYTES = 6_000_000
PART_BYTES = 24_000_000
PIECE = 1_000_000
#: Bytes of different fragments that a task merges, and in one of its shards; of one key before it counts as hot.
MERGE_BYTES = 1_000_000
SHARD_BYTES = 250_000
HOT_BYTES = 1_000_000
#: Most tasks that an exchange deals to; more groups share a task, which takes them one after the other.
MOST_TASKS = 50_000
LAST_ID = (1 << 63) - 1
U = np.uint64


def words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each position on, as numbers."""
    return np.ndarray((len(data) - 7,), f"{order}u8", data, strides=(1,)).astype(U)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def window_keys(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The smallest gram hash inside the window from each position on; at least ``window`` bytes are given."""
    w = words_at(data, "<")
    n = len(data) - GRAM + 1
    h = mixed(w[:n] * U(0x9E3779B97F4A7C15) + w[8 : 8 + n] * U(0xD6E8FEB86659FD93) + w[16 : 16 + n] * U(0xA0761D6478BD642F))
    need, have = window - GRAM + 1, 1
    while have * 2 <= need:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (need - have)], h[need - have :]) if need > have else h


def pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) with about ``PIECE`` bytes each; each window of a text lies in one of its pieces."""
    held, total = [], 0
    for t, data in enumerate(texts):
        for at in range(0, max(1, len(data) - window + 1), max(1, PIECE - window + 1)):
            held.append((t, at, data[at : at + PIECE] if len(data) > PIECE else data))
            total += len(held[-1][2])
            if total >= PIECE:
                yield held
                held, total = [], 0
    if held:
        yield held


def fragments(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, key) of runs of windows of one key, over all texts."""
    parts: list[tuple] = []
    for held in pieces(texts, window):
        sizes = np.asarray([len(d) for _, _, d in held])
        if sizes.sum() < window:
            continue
        data = np.frombuffer(b"".join(d for _, _, d in held), np.uint8)
        key = window_keys(data, window)
        owner = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        start_of = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = owner[: len(key)] == owner[window - 1 :]
        change = (key[1:] != key[:-1]) | (owner[1 : len(key)] != owner[: len(key) - 1]) | (inside[1:] != inside[:-1])
        begin = np.concatenate([[0], np.flatnonzero(change) + 1])
        end = np.concatenate([begin[1:], [len(key)]])
        good = inside[begin]
        begin, end = begin[good], end[good]
        own = owner[begin]
        text, offset = np.asarray([t for t, _, _ in held], np.int32), np.asarray([o for _, o, _ in held])
        parts.append((text[own], (begin - start_of[own] + offset[own]).astype(np.int32), (end - begin).astype(np.int32), mixed(key[begin])))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int32, np.int32, np.int32, U))  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def dense(values: np.ndarray) -> np.ndarray:
    """Ranks of values, equal ones alike."""
    order = np.argsort(values)
    ordered = values[order]
    rank = np.empty(len(values), np.uint32)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1], dtype=np.uint32)])
    return rank


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Positions of a cyclic text, ordered by the 64 bytes from each on; ties in any order.

    ``words`` ranks the eight bytes from each position on; ranks of twice the length come from pairs.
    """
    rank, step = words, WORD
    while True:
        key = (rank.astype(U) << U(32)) | np.roll(rank, -step)
        step *= 2
        if step == 64:
            return np.argsort(key).astype(np.int32)
        rank = dense(key)


def sorted_by(symbols: np.ndarray) -> np.ndarray:
    """Stable order of symbols under 2^32, by a counting sort of each half."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
    high = (symbols >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merged_transforms(shards: list[np.ndarray], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, common): all suffixes of the shards in merged order, positions counted over the shards one after
    the other, and the bytes that each has in common with the one before it, exact below ``depth``.

    A shard's transform holds, in suffix order, what comes before each suffix. Symbols are words of eight
    bytes from the merged alphabet of all shards, so a round refines by a whole word.
    """
    sizes = np.asarray([len(s) for s in shards])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    wide = [words_at(np.concatenate([s, np.resize(s, WORD - 1)]), ">") for s in shards]
    own = [np.unique(w, return_inverse=True) for w in wide]
    alphabet = distinct(np.concatenate([a for a, _ in own]))
    symbols_of = [np.searchsorted(alphabet, a).astype(np.uint32)[code] for a, code in own]
    orders = [suffix_order(code.astype(np.uint32)) for _, code in own]
    transforms = [w[o - WORD] for w, o in zip(symbols_of, orders, strict=True)]
    del own, symbols_of
    rounds = -(-depth // WORD)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    block = np.zeros(len(source), np.int32)
    first_border = np.full(len(source), rounds, np.uint8)  # the round at which a border appears before a place
    symbol = np.empty(len(source), np.uint32)
    for r in range(rounds):
        for s, transform in enumerate(transforms):
            symbol[source == s] = transform
        by_symbol = sorted_by(symbol)
        source, block, ordered = source[by_symbol], block[by_symbol], symbol[by_symbol]
        border = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (block[1:] != block[:-1])])
        first_border[border & (first_border == rounds)] = r
        block = np.cumsum(border, dtype=np.int32)
    position = np.empty(len(source), np.int64)
    for s, (order, before) in enumerate(zip(orders, starts, strict=True)):
        position[source == s] = order + before
    common = first_border.astype(np.int32) * WORD
    at = np.flatnonzero(first_border[1:] < rounds) + 1
    every = np.concatenate(wide)
    skip = common[at]

    def word_from(places: np.ndarray) -> np.ndarray:
        shard = source[places]
        return every[starts[shard] + (position[places] - starts[shard] + skip) % sizes[shard]]

    differ = word_from(at) ^ word_from(at - 1)
    for b in range(1, WORD):
        common[at] += (differ >> U(64 - 8 * b)) == 0
    return position, common


def repeated_windows(parts: list[bytes], first: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each fragment the (start, end) pairs of its bytes covered by a window that a fragment of a smaller document holds too."""
    total = sum(len(p) + 1 for p in parts)
    count = min(255, max(2, -(-total // SHARD_BYTES)), len(parts))
    cuts = np.linspace(0, len(parts), count + 1).astype(int)
    shards = [np.frombuffer(b"\0".join(parts[a:b]) + b"\0", np.uint8) for a, b in zip(cuts, cuts[1:], strict=False)]
    position, common = merged_transforms(shards, window)
    sizes = np.asarray([len(p) + 1 for p in parts], np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    whole = np.arange(total, dtype=np.int32) + window < starts[owner] + sizes[owner]  # windows that end inside their fragment
    rank = np.unique(first, return_inverse=True)[1].astype(np.int32)[owner]
    ranked = np.where(whole, rank, np.int32(2**31 - 1))[position]
    begins = np.flatnonzero(common < window)  # a repeated interval goes on while the common prefix reaches the window
    smallest = np.minimum.reduceat(ranked, begins)
    lowest = np.empty(total, np.int32)
    lowest[position] = np.repeat(smallest, np.diff(np.concatenate([begins, [total]])))
    hit = np.flatnonzero(whole & (lowest < rank))
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(parts)
    if len(hit):
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
        begin = hit[new]
        end = hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])] + window
        own = owner[begin]
        pairs = np.stack([begin - starts[own], end - starts[own]], 1).astype(np.int32)
        edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        for a, b in zip(edges, edges[1:], strict=False):
            out[own[a]] = pairs[a:b].ravel()
    return out


def _packed(keys: np.ndarray) -> bytes:
    """Five bytes a key: with the part that it is dealt to, all but a few of its 64 bits."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _short(keys: np.ndarray) -> np.ndarray:
    return keys >> U(24) & U((1 << 40) - 1)


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices of its keys) for the parts of the key space that have any."""
    part = (keys % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    for p, own in zip(found.tolist(), np.split(order, begin[1:]), strict=bool(len(found))):
        yield p, own


def once_a_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text of a task once, and at the end the smallest document of those texts that came again."""
    smallest: dict[tuple, int] = {}
    again: set[tuple] = set()
    for frame in frames:
        fresh = np.zeros(len(frame), bool)
        for k, (doc, *text) in enumerate(zip(frame["doc"].tolist(), frame["mark"].tolist(), frame["mark2"].tolist(), strict=True)):
            mark = tuple(text)
            if mark not in smallest:
                smallest[mark], fresh[k] = doc, True
            elif doc < smallest[mark]:
                smallest[mark] = doc
                again.add(mark)
        yield frame[fresh]
    if again:
        yield pd.DataFrame([(smallest[m], *m, None) for m in again], columns=["doc", "mark", "mark2", "data"])


def folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a text, of its smallest document, from rows of which some have no data."""
    doc = pdf.groupby(["mark", "mark2"])["doc"].transform("min")
    return pdf.assign(doc=doc)[pdf["data"].notna()].drop_duplicates(["mark", "mark2"])


FOUND = "doc long, mark long, mark2 long, start int, size int, key long, print long, low long, part binary"


def repeated_fragments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``FOUND`` rows of the fragments whose key occurs in two different texts or more.

    ``docs`` has (doc, mark, mark2, data), marks standing for the text. Equal texts are folded inside tasks
    before the shuffle, and then by group. Of equal fragments of a group one has the bytes and the smallest
    document (part, low), so what follows sees each at most once a group.
    """
    import xxhash

    size = docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    groups, parts = max(8, -(-size // GROUP_BYTES)), max(8, -(-size // PART_BYTES))
    texts_once = docs.mapInPandas(once_a_task, "doc long, mark long, mark2 long, data binary")
    dealt = texts_once.withColumn("g", F.pmod("mark", F.lit(groups)).cast("int")).repartition(min(groups, MOST_TASKS), "g")

    def keys_of(pdf: pd.DataFrame) -> pd.DataFrame:
        text, _, _, key = fragments(folded(pdf)["data"].tolist(), window)
        order = np.argsort(key, kind="stable")
        key, text = key[order], text[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        end = np.concatenate([begin[1:], [len(key)]]).astype(int)
        twice = text[end - 1] != text[begin] if len(key) else np.empty(0, bool)
        key = key[begin]
        short = _short(key)
        rows = [(p, pdf["g"].iat[0], _packed(short[own]), np.packbits(twice[own]).tobytes()) for p, own in _by_part(key, parts)]
        return pd.DataFrame(rows, columns=["p", "g", "keys", "twice"])

    def shared_of(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_unpacked(b) for b in pdf["keys"]]
        twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool) for b, k in zip(pdf["twice"], each, strict=True)]
        every = np.sort(np.concatenate([*each, *(k[t] for k, t in zip(each, twice, strict=True))]))
        again = distinct(every[1:][every[1:] == every[:-1]])
        rows = []
        for g, k in zip(pdf["g"], each, strict=True):
            own = k[among(k, again)]
            if len(own):
                rows.append((g, pdf["p"].iat[0], _packed(own)))
        return pd.DataFrame(rows, columns=["g", "p", "keys"])

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.split()[0]: [] for f in FOUND.split(", ")})
        left = folded(left)
        texts = left["data"].tolist()
        text, start, windows, key = fragments(texts, window)
        short, keep = _short(key), np.zeros(len(key), bool)
        shared = dict(zip(right["p"].tolist(), right["keys"], strict=True))
        for p, own in _by_part(key, parts):
            if p in shared:
                keep[own] = among(short[own], np.sort(_unpacked(shared[p])))
        text, start, size, key = text[keep], start[keep], windows[keep] + np.int32(window - 1), key[keep].view(np.int64)
        doc, mark, mark2 = (left[c].to_numpy()[text] for c in ("doc", "mark", "mark2"))
        cuts = [texts[t][s : s + n] for t, s, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True)]
        told = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in cuts), np.uint64, len(cuts)).view(np.int64)
        order = np.lexsort((doc, told, key))
        new = np.concatenate([[True], (told[order][1:] != told[order][:-1]) | (key[order][1:] != key[order][:-1])]) if len(order) else np.empty(0, bool)
        least = order[new]
        low, part = np.full(len(key), -1), np.full(len(key), None, object)
        low[least] = doc[least]
        for k in least.tolist():
            part[k] = cuts[k]
        return pd.DataFrame({"doc": doc, "mark": mark, "mark2": mark2, "start": start, "size": size, "key": key, "print": told, "low": low, "part": part})

    keys = dealt.groupBy("g").applyInPandas(keys_of, "p int, g int, keys binary, twice binary")
    shared = keys.repartition(min(parts, MOST_TASKS), "p").groupBy("p").applyInPandas(shared_of, "g int, p int, keys binary")
    return dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInPandas(cut, FOUND)


def hot_windows(fragments_of_hot: DataFrame, window: int) -> DataFrame:
    """(key, print, first, spans) of different fragments (key, print, part, first), by the hashes of their windows."""
    starts = F.sequence(F.lit(0), F.octet_length("part") - window)
    at = F.posexplode(F.transform(starts, lambda i: F.substring("part", i + 1, F.lit(window)))).alias("at", "w")
    rows = fragments_of_hot.select("key", "print", "first", at).select("key", "print", "first", "at", F.xxhash64("w").alias("h"), F.xxhash64(F.lit("second"), "w").alias("h2"))
    lowest = rows.groupBy("h", "h2").agg(F.min("first").alias("lowest"))
    hit = rows.join(lowest, ["h", "h2"]).filter("lowest < first")
    spans = hit.groupBy("key", "print").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + window))).alias("spans"))
    known = fragments_of_hot.select("key", "print", "first")
    return known.join(spans, ["key", "print"], "left").select("key", "print", "first", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"))


def decided(found: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(key, print, first, spans) of each different fragment: its smallest document, and the ranges that a smaller one than that repeats."""
    given = found.filter("part IS NOT NULL")
    weight = F.sum(F.col("size").cast("long"))
    hot = scratch.store(given.groupBy("key").agg(weight.alias("bytes")).filter(F.col("bytes") > HOT_BYTES).select("key"))
    # Joined by broadcast only if the stored table is small enough for Spark to choose that.
    different = given.groupBy("key", "print", "part").agg(F.min("low").alias("first"))
    different = scratch.store(different.join(hot.withColumn("hot", F.lit(True)), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    cool = different.filter("NOT hot")
    size = cool.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    tasks = max(8, -(-size // MERGE_BYTES))
    placed = cool.select("key", "print", "part", "first", F.pmod("key", F.lit(tasks)).cast("int").alias("task")).repartition(min(max(8, tasks // 4), MOST_TASKS), "task")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["first"].to_numpy()
        spans: list[np.ndarray] = [np.empty(0, np.int32)] * len(pdf)
        shared = np.flatnonzero(pdf["key"].duplicated(keep=False))
        if len(shared):
            parts = pdf["part"].to_numpy()[shared].tolist()
            for k, found_spans in zip(shared.tolist(), repeated_windows(parts, first[shared], window), strict=True):
                spans[k] = found_spans
        return pd.DataFrame({"key": pdf["key"], "print": pdf["print"], "first": first, "spans": spans})

    merged = placed.groupBy("task").applyInPandas(merge, "key long, print long, first long, spans array<int>")
    return scratch.store(merged.unionByName(hot_windows(different.filter("hot"), window)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, data, spans) for every row: spans are the maximal removed byte ranges as start, end, start, end ..."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("doc"), data.alias("data"))
    rows = rows.withColumns({"mark": F.xxhash64("data"), "mark2": F.xxhash64(F.lit("second"), "data")})
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.store(repeated_fragments(rows.select("doc", "mark", "mark2", "data"), window))
        merged = decided(found, scratch, window)
        start = F.col("start")
        own = F.when(F.col("doc") > F.col("first"), F.array(start, start + F.col("size"))).otherwise(F.transform("spans", lambda x: x + start))
        spans = found.select("doc", "mark", "mark2", "start", "size", "key", "print").join(merged, ["key", "print"])
        spans = spans.select("mark", "mark2", own.alias("spans")).filter(F.size("spans") > 0)
        spans = scratch.store(spans.groupBy("mark", "mark2").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInPandas(united, "mark long, mark2 long, spans array<int>"))
        texts = rows.groupBy("mark", "mark2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).join(spans, ["mark", "mark2"], "left")
        of_text = stored(texts.filter("copies > 1 OR spans IS NOT NULL").drop("copies"))
    size_of = F.octet_length("data")
    whole = F.when(size_of >= window, F.array(F.lit(0), size_of))  # a copy of a text that a smaller document has
    removed = F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("spans"))
    # Both sides are plain exchanges, so the copies of one text can be dealt to several tasks.
    judged = rows.join(of_text, ["mark", "mark2"], "left")
    return judged.select("doc_id", "data", F.coalesce(removed, F.array().cast("array<int>")).alias("spans"))


def united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["spans"] = [joined(s) for s in frame["spans"]]
        yield frame


def joined(spans) -> np.ndarray:
    """Sorted maximal ranges from overlapping or touching ones."""
    if spans is None or not len(spans):
        return np.empty(0, np.int32)
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    begin = pairs[new, 0]
    end = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]])]
    return np.stack([begin, end], 1).ravel().astype(np.int32)


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow keeps ids as they are; pandas would turn those beside null ones into floats.
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
                data, spans = data.as_buffer(), spans.values.to_numpy()
                h, at, removed = hashlib.sha256(), 0, 0
                for a, b in spans.reshape(-1, 2).tolist():
                    h.update(data[at:a])
                    at, removed = b, removed + b - a
                h.update(data[at:])
                out.append((len(data), removed, len(spans) // 2, h.hexdigest()))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove_repeats(docs).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: All strings of 50 bytes, as hexadecimal digits, with the smallest document of each.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
lowest AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT doc_id, i FROM w JOIN lowest USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS head, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS done
  FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op2_suffix_dedup": op2_query}
SQL = {"op2_suffix_dedup": OP2_SQL}
