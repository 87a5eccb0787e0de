"""Token ids as Parquet list columns: ordered files with chosen encoding, row groups and page indexes."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text taken at a time, on average.
SLICE = 8 << 20
#: Words remembered by a worker, and the longest word worth remembering.
REMEMBERED, LONGEST = 500_000, 48
# Fixed value: the pattern by which the word-level vocabulary splits normalised text, for words without white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
_WORDS = re.compile("[^\t-\r \x85\xa0  -     　]+").findall


class WordEncoder:
    """Encodes texts word by word with a vocabulary of the tokenizers library whose pieces never cross white space.

    Such vocabularies normalise, split and merge each word alike wherever it stands, so the library's answer for a distinct
    piece is kept and used again. Words of Latin letters are split here by the file's own pattern; words with any other
    character, or with a special token, go to the library whole. Many new pieces go to the library as one line and come
    apart at the tokens that end a word.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.library.model)  # for ASCII pieces, which the file's own steps before the model leave as they are
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spec = json.loads(self.library.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.simple = regex.compile("[!-~\xa1-\u024f]+").fullmatch
        self.pieces = regex.compile(PIECES).findall
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, np.int32).tobytes()

    def _learn(self, new: set[str], special: bool) -> dict[str, bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        one, many, out, pieces, simple, nfc = {}, {}, {}, self.pieces, self.simple, unicodedata.is_normalized
        for w in new:
            if special and any(x in w for x in self.special) or not (w.isascii() or simple(w) and nfc("NFC", w)):
                out[w] = self._whole(w)
            elif w.isalpha():
                low = w.lower()
                one[w] = w if low == w else low  # one string for both memories
            else:
                many[w] = pieces(w.lower())
        known = self.known
        unknown = set(one.values()).union(*many.values()).difference(known)
        plain = [p for p in unknown if p.isascii() and p.isprintable()]
        for library, pieces_ in ((self.plain, plain), (self.library, [*unknown.difference(plain)])):
            for at in range(0, len(pieces_), 1024):
                part = pieces_[at : at + 1024]
                ids = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(part) and stops[-1] == len(ids):
                    data, stops = ids.tobytes(), (stops * 4).tolist()
                    known.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops)]))
                else:
                    known.update((p, self._whole(p)) for p in part)
        out.update(zip(one, map(known.__getitem__, one.values())))
        for w, x in many.items():
            out[w] = b"".join([known[p] for p in x])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        odd = ((data >= 0x1C) & (data <= 0x1F)).any()  # Python and Arrow split there, Unicode doesn't
        words = pa.array(map(_WORDS, texts.to_pylist()), pa.list_(pa.string())) if odd else pc.utf8_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        names, known = coded.dictionary.to_pylist(), self.words
        if len(known) > REMEMBERED:
            known.clear()
        special = any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special)
        found = self._learn(set(names).difference(known), special)
        known.update(found)
        each = list(map(known.__getitem__, names))
        for w in found:
            if len(w) > LONGEST:
                del known[w]
        pool = np.frombuffer(b"".join(each), np.int32)
        sizes = np.fromiter(map(len, each), np.int32, len(each)) // 4
        of = coded.indices.to_numpy()
        n = sizes[of]
        stops = np.cumsum(n)
        flat = pool[np.repeat((np.cumsum(sizes) - sizes)[of] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)]
        return flat, np.diff(np.r_[0, stops][words.offsets.to_numpy() - words.offsets[0].as_py()])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, text: str = "text", key: str = "doc_id", encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 1024, files: int | None = None, encoder: Callable[[str], WordEncoder] = word_encoder) -> None:
    """Write (part, key, local_start, n_tokens, ids) in ascending order of key.

    File k holds the k-th range of keys; local_start counts the ids before a document in its file. ids is a list of ints,
    with dictionary or delta encoding, in row groups of about row_group_bytes; the writer adds column and offset indexes for
    pages of at most page_rows rows, so that readers of few keys or few columns skip the other pages. Null and empty texts
    have the end id alone. Null keys come first; rows that repeat a key follow each other by the hash of their text.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, at, part = encoder(vocabulary), 0, TaskContext.get().partitionId()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(SLICE, batch.column(1).nbytes))
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                ids, n = e.encode(some.column(1))
                stops = np.cumsum(n + 1)
                flat = np.full(stops[-1], end_id, np.int32)
                inner = np.ones(len(flat), bool)
                inner[stops - 1] = False
                flat[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), some.column(0), pa.array(at + stops - n - 1), pa.array(n + 1), lists], names=["part", "key", "local_start", "n_tokens", "ids"])
                at += int(stops[-1])

    out = ordered.mapInArrow(run, f"part int, key {kind}, local_start long, n_tokens long, ids array<int>").withColumnRenamed("key", key)
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": str(1 << 20)}
    if encoding == "delta":
        options["parquet.writer.version"] = "PARQUET_2_0"
    out.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The table write_tokens() wrote; filters on its columns reach the page indexes, and unread columns stay on disk."""
    return spark.read.parquet(path)


def starts(tokens: DataFrame) -> DataFrame:
    """(part, part_start): ids before each file, from the n_tokens column alone; one row a file."""
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from the files' lists: place among all ids, count and CRC-32 of the little-endian uint32 ids."""
    ship(tokens.sparkSession)
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "key", "local_start", "n_tokens", "ids_crc32"])

    each = tokens.select("part", F.col(key).alias("key"), "local_start", "ids").mapInArrow(run, f"part int, key {kind}, local_start long, n_tokens long, ids_crc32 long")
    return each.join(starts(tokens), "part").select(F.col("key").alias(key), (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
