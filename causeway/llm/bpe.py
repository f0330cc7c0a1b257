"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pieces up to so many characters are remembered, and so many of them in each of two generations, in every Python worker: at most about 350 MB.
KEEP_CHARS, KEEP = 32, 700_000
#: Pieces of a text that are looked up at once.
STEP = 4096


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: its own rank, or what is left after merging the pair of least rank, leftmost first, again and again.

    A segment tree over the byte positions keeps the leftmost least pair rank. Leaf i holds rank * n + i of the pair that starts at byte i (so
    that the least number is the leftmost of the least rank), or `far` where no live token starts or no pair is known. A merge
    changes the leaves of the live neighbours only: three updates of logarithmic cost.
    """
    own = ranks.get(piece)
    if own is not None:
        return [own]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    far = 1 << 62
    tree = [far] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    while tree[1] < far:
        i = tree[1] % n
        gone = after[i]
        end = after[gone]
        after[i] = end
        put(gone, far)
        if end < n:
            before[end] = i
            r = ranks.get(piece[i : after[end]])
            put(i, far if r is None else r * n + i)
        else:
            put(i, far)
        left = before[i]
        if left >= 0:
            r = ranks.get(piece[left:end])
            put(left, far if r is None else r * n + left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def ascii_pattern(pattern: str) -> str | None:
    """The pattern as ASCII texts see it, for Python's own engine, which is faster; None if it has more than letters, numbers and white space."""
    inside, out, i = False, [], 0
    while i < len(pattern):
        for name, members in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9")):
            if pattern.startswith(name, i):
                out.append(members if inside else f"[{members}]")
                i += len(name)
                break
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    made = "".join(out)
    return None if r"\p" in made or r"\P" in made else made


class Codec:
    """Encodes and decodes with one rank file. The ids of short pieces are remembered, as bytes of 32-bit integers, in two
    generations: when the younger is full it becomes the older, whose pieces are taken over again when they are met."""

    def __init__(self, path: str, pattern: str, keep: int = KEEP):
        self.keep = keep
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.plain = re.compile(plain, re.ASCII).findall if plain else self.split
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokens = {i: t for t, i in self.ranks.items()}

    def piece(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= KEEP_CHARS:
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        pieces, out = (self.plain if text.isascii() else self.split)(text), []
        for at in range(0, len(pieces), STEP):  # generations change between steps only, so a text of any length can outgrow one by STEP pieces at most
            if len(self.young) >= self.keep:
                self.old, self.young = self.young, {}
            get, make = self.young.get, self.piece
            out.append(b"".join([get(p) or make(p) for p in pieces[at : at + STEP]]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, keep: int = KEEP) -> Codec:
    return Codec(path, pattern, keep)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", keep: int = KEEP) -> DataFrame:
    """df with the token ids of every whole text, as an array of integers.

    keep: pieces that a worker remembers in each of two generations, about 250 bytes each; ids are the same whatever it is. ranks: path of a rank file, which every executor must have; pattern: splits a text into pieces, each encoded separately. Null and
    empty texts give an empty array; special tokens are ordinary text. A column named `ids` is replaced, others stay. Rows are independent, so
    repeated rows and ties need no rule. A piece of n bytes takes about n log n steps, so very long words are no trouble.
    """
    common.small_batches(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        own = codec(ranks, pattern, keep)
        return _lists([own.encode(t) if t else np.empty(0, np.int32) for t in texts.to_pylist()])

    return df.withColumn(ids, run(common.whole_text(text)))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", data: str = "decoded", keep: int = KEEP) -> DataFrame:
    """df with the bytes that arrays of ids stand for; a null array gives no bytes, an unknown id fails the job."""
    common.small_batches(df.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array) -> pa.Array:
        own = codec(ranks, pattern, keep)
        flat, ends = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy())])
        return pa.array([own.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())

    return df.withColumn(data, run(F.col(ids)))


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every document."""
    coded = decode(encode(docs.select("doc_id", "text"), ranks, pattern).select("doc_id", "ids"), ranks, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
