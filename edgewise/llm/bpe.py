"""Byte-level BPE encoding and decoding with the rank file of a public tokenizer.

Each match of the split pattern is a piece of its own. A piece is encoded without running merges:
its bytes are mapped to Latin-1 characters, an Aho-Corasick automaton over the vocabulary gives the
tokens that occur at each position, and the encoder walks left to right, always taking the longest
token that is compatible with the one before, stepping back when none fits. Two adjacent tokens are
compatible when BPE on their joined bytes would give just those two; this is decided from the merge
ranks once a pair and memoised. A position from which the walk had to step back is never tried
again, so the walk is linear in the piece, and the result equals that of the exact merges.

Pieces repeat, so their ids are cached up to a stated number of pieces; the cache only saves time.

Edge cases: a null text is treated as empty and gives no tokens; an empty table gives an empty
result; texts of any length are encoded whole; characters outside the pattern's classes cannot
occur, since the pattern covers every character; repeated rows are encoded alike; other columns
of the input pass through ``encode_column`` untouched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept in a worker's cache before it is emptied.
CACHE_PIECES = 600_000
CACHE_PAIRS = 2_000_000


class BytePairCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        #: The two tokens whose merge makes a token; none for single bytes.
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.uneven = re.compile(r" (?!\S)").search
        self.cut = re.compile(r" (?=\S)").split
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, i in ranks.items():
            if len(token) > 1:
                parts = self._merge(token, i)
                if len(parts) != 2:
                    continue  # no merge makes it: it stands for a whole piece only
                self.halves[i] = (parts[0], parts[1])
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Exact merges of ``data`` with ranks under ``below``; used once a token, on its own bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps ``left`` and ``right`` apart and whole where they are adjacent.

        The merges that made the two tokens are undone from the latest on. At each step the tokens at
        the seam must not form a token that would have been merged before one of them was made.
        """
        key = left << 20 | right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            got = self.fits[key] = self._compatible(left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.token[left] + self.token[right])
            if joined is not None and joined < limit:
                return False
            inner, outer = self.halves.get(left), self.halves.get(right)
            if inner is None and outer is None:
                return True
            if outer is None or (inner is not None and left > right):
                limit, left = left, inner[1]
            else:  # of equal ranks the merge further left comes first
                limit, right = right + 1, outer[0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, fits = len(piece), self.fits
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            starting[end + 1 - size].append((token, end + 1))  # shorter before longer at each start
        dead = bytearray(n + 1)
        path: list[tuple[int, int, int]] = []  # token before, place before, matches left untried there
        before, at, left = -1, 0, starting[0]
        while True:
            while left:
                token, to = left.pop()
                if dead[to]:
                    continue
                if before >= 0:
                    fit = fits.get(before << 20 | token)
                    if fit is None:
                        fit = self.compatible(before, token)
                    if not fit:
                        continue
                path.append((before, at, token))
                before, at = token, to
                break
            else:
                dead[at] = 1
                before, at, _ = path.pop()
                left = starting[at]
                continue
            if at == n:
                return tuple([token for _, _, token in path])
            left = starting[at]

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pieces
        if len(pieces) > CACHE_PIECES:
            pieces.clear()
        out: list[int] = []
        for p in self.split(chunk):
            ids = pieces.get(p)
            if ids is None:
                ids = pieces[p] = self.encode_piece(p.encode())
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``. The pattern never joins a space that comes before a non-space to what is before it,
        so the text is cut there first and the ids of what lies between are cached."""
        words, out = self.words, []
        if len(words) > CACHE_PIECES:
            words.clear()
        cut = text.split(" ") if not self.uneven(text) else self.cut(text)
        first = cut[0]
        if first:
            out += self.encode_chunk(first)
        for w in cut[1:]:
            ids = words.get(w)
            if ids is None:
                ids = words[w] = self.encode_chunk(" " + w)
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec a worker process."""
    return BytePairCodec.load(path, pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text as an array of ints.

    ``path`` is read on the executors, where the tokenizer package is installed; only the path
    travels with the job.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in texts:
            yield pd.Series([c.encode(t or "") for t in s])

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode_column(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the token ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def joined(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in ids:
            yield pd.Series([None if i is None else c.decode(i) for i in s])

    return docs.withColumn(bytes_col, joined(F.col(ids_col)))


def encode_checked(docs: DataFrame, path: str, pattern: str, text_col: str = "text", rows_a_batch: int = 256) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids, and whether the ids decode to the text's bytes; few rows leave at once."""
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids", "round_trip")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*rest).schema) + "n_tokens long, ids array<int>, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_batch):
                part = batch.slice(at, rows_a_batch)
                texts = [t or "" for t in part.column(len(rest)).to_pylist()]
                ids = [c.encode(t) for t in texts]
                same = [c.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True)]
                added = [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *added], [*part.schema.names[: len(rest)], "n_tokens", "ids", "round_trip"])

    # Arrow keeps the other columns as they are; pandas would turn ids beside null ones into floats.
    return docs.select(*rest, text_col).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip of each text in one pass, without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        names = {i: str(i) for i in c.token}
        for batch in batches:
            out = []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or "")
                said = " ".join(map(names.__getitem__, ids)).encode()
                out.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op3_bpe": op3_query}
#: SQL has no tokenizer; the query is tested against an independent implementation of the merges.
SQL: dict[str, str] = {}
