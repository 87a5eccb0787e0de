"""Exact byte-level BPE by dynamic programming over prefixes, and its decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, trimmed

# Unicode white space, and the pre-token pattern of byte-level BPE files.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces that a task remembers (some 60 MB), the longest piece worth remembering, and pairs of tokens (some 30 MB).
REMEMBERED, LONGEST, PAIRS = 250_000, 48, 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with exact encoding and decoding.

    Tokens are numbered by rank: the 256 bytes first, then the results of the merges in order. For every prefix of a piece
    there is exactly one token that the encoding of that prefix ends with; it is the one token, among those that match a
    suffix of the prefix, that may follow the last token of the shorter prefix.

    Served are files whose pre-tokens are PATTERN's (the library fixes that pattern, not the file), whose merges make each token in
    one way (another raises ValueError) and whose added tokens are matched as they stand, without flags for neighbouring spaces.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        vocab = model["vocab"]
        raw = {t: bytes(alphabet[c] for c in t) for t in vocab}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = sorted((t for t in vocab if len(raw[t]) == 1), key=lambda t: raw[t])
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        rank = {t: k for k, t in enumerate(order)}
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b in rank:
                raise ValueError("a token that two merges make has no unique history")
            rank[a + b] = len(order)
            self.joined[rank[a], rank[b]] = len(order)
            self.left.append(rank[a])
            self.right.append(rank[b])
            order.append(a + b)
        self.ids = [vocab[t] for t in order]
        self.bytes_of: dict[int, bytes] = {vocab[t]: raw[t] for t in order}
        added = spec.get("added_tokens", [])
        if any(x.get(flag) for x in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in neighbouring spaces, or stand as single words, are not served")
        self.specials = {x["content"]: x["id"] for x in added}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.matcher = ahocorasick.Automaton()
        for k, t in enumerate(order):
            self.matcher.add_word(raw[t].decode("latin-1"), (len(raw[t]), k))
        self.matcher.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether a, then b, survive side by side: undo their merges, latest first, and look for an earlier merge across the border."""
        bound = 1 << 60
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < bound:
                return False
            can_a, can_b = self.left[a] != a, self.left[b] != b
            if can_a and (a > b or not can_b):
                bound, a = a, self.right[a]  # on a tie the merge further left goes first
            elif can_b:
                bound, b = b + 1, self.left[b]
            else:
                return True

    def _follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[key] = self._may_follow(a, b)
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8").decode("latin-1")
        last, from_ = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        fit = self.fits.get
        for end, (length, token) in self.matcher.iter(data):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start:
                    fits = fit(last[start] << 20 | token)
                    if fits is None:
                        fits = self._follows(last[start], token)
                        fit = self.fits.get
                    if not fits:
                        continue
                last[end + 1], from_[end + 1] = token, start
        out, at, ids = [], len(data), self.ids
        while at:
            out.append(ids[last[at]])
            at = from_[at]
        return tuple(out[::-1])

    def __missing(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that isn't among the latest half of those remembered; what is asked for again stays in that half."""
        ids = self.known.get(piece) or self.older.get(piece) or self.encode_piece(piece)
        if len(piece) <= LONGEST:
            if 2 * len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, missing, out = self.known.get, self.__missing, []
        for part in self.parts(text) if self.parts else (text,):
            if part in self.specials:
                out.append((self.specials[part],))
            elif part:
                out += [get(p) or missing(p) for p in self.pieces(part)]
        return list(chain.from_iterable(out))

    def forget(self) -> None:
        """Drop what was remembered of pieces and pairs."""
        self.known, self.older, self.fits = {}, {}, {}

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; unknown ids give nothing, stray bytes the replacement character."""
        none: dict = self.bytes_of
        return b"".join([none.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def _forgetting(vocabulary: str, run):
    """run, after which the worker keeps the vocabulary but nothing that it remembered."""

    def and_forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            codec(vocabulary).forget()

    return trimmed(and_forget)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): the token ids of every whole text; null and empty texts have none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([codec(vocabulary).encode(x.as_py() or "") for x in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_forgetting(vocabulary, run), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text): the text of every row of ids; a null list has the empty text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(vocabulary).decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip_digests(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, leaving only digests.

    The same codec as encode() and decode(); the ids and the decoded text stay in the worker. Rows repeated, null or
    empty give their row like any other.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        names = [str(i) for i in range(max(c.bytes_of) + 1)]
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1):
                ids = c.encode(x.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_forgetting(vocabulary, run), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
