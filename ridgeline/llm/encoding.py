"""Encoding of a whole corpus with a public byte-level BPE.

Pre-tokens are cut on the JVM. Each block of documents keeps a dictionary of its distinct words and,
per document, the places of its words in it: words leave a block once, not once an occurrence. The
dictionaries' words go through one global shuffle to their distinct set, each distinct word is
encoded once, the ids return to the blocks by word, and every document is reassembled by position.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import spread, staged

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("RIDGELINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words of a block: bounds the memory of reassembling one.
BLOCK_WORDS = 300_000
#: Blocks a word is joined with in one place; more are dealt out to several.
WORD_BLOCKS = 10_000
# Fixed value: the public pre-token pattern of the vocabulary, with Unicode white space for Java.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """The tiktoken encoding of a vocabulary file, once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _blocks(block_words: int):
    """(key, words) batches to blocks: a row per document with its places, then one with the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        names = ["block", "key", "places", "words"]
        for b in batches:
            keys, words = b.column("key"), b.column("words")
            offsets = words.offsets.to_numpy()
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_words, side="right")) - 1)
                j = min(j, len(b))
                flat = words.values.slice(offsets[i], offsets[j] - offsets[i]).dictionary_encode()
                block = (part << 32) + number
                number += 1
                places = pa.ListArray.from_arrays(pa.array(offsets[i : j + 1] - offsets[i], pa.int32()), flat.indices.cast(pa.int32()))
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), keys.slice(i, n), places, pa.nulls(n, pa.list_(pa.string()))], names=names
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary),
                    ],
                    names=names,
                )
                i = j

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _encoder(path)._encode_single_piece
        for b in batches:
            words = b.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array([piece(w) for w in words.to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _assemble(documents: pa.Table, dictionary: pa.Table) -> pa.Table:
    """One block: its documents' places replaced by the ids of the words there."""
    places = documents.column("places").combine_chunks()
    if isinstance(places, pa.ChunkedArray):
        places = places.chunk(0) if places.num_chunks else pa.array([], places.type)
    at = dictionary.column("place").to_numpy()
    lists = dictionary.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    starts, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = int(at.max()) + 1 if len(at) else 0
    begin, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
    begin[at], count[at] = starts[:-1], np.diff(starts)
    offsets = places.offsets.to_numpy()
    flat = places.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    n = count[flat]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(begin[flat] - (ends - n), n)
    bounds = np.r_[0, ends][offsets - offsets[0]]
    out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[take] if total else np.empty(0, np.int32), pa.int32()))
    return pa.table({"key": documents.column("key"), "ids": out, "n": pa.array(np.diff(bounds).astype(np.int64))})


def _encoded(texts: DataFrame, tokenizers: str, vocabulary: str, block_words: int, word_blocks: int = WORD_BLOCKS) -> DataFrame:
    """(key, ids, n) of `texts` (key BIGINT, text STRING), a row for each row."""
    path = f"{tokenizers}/{vocabulary}"
    words = spread(texts).select("key", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATTERN), F.lit(0)).alias("words"))
    blocks = staged(words.mapInArrow(_blocks(block_words), "block long, key long, places array<int>, words array<string>"), "blocks")
    dictionary = blocks.where("words is not null").select("block", F.posexplode("words").alias("place", "word"))
    ids = dictionary.select("word").distinct().mapInArrow(_encode(path), "word string, ids array<int>")
    # a common word stands in every block; so that it doesn't fill one task, its blocks are dealt out to parts
    parts = 1 + blocks.where("words is not null").count() // word_blocks
    if parts > 1:
        dictionary = dictionary.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
        ids = dictionary.select("word", "part").distinct().join(ids, "word")  # at most `parts` rows a word
    back = dictionary.join(ids, ["word", "part"] if parts > 1 else ["word"]).select(F.col("block").alias("own_block"), "place", "ids")
    documents = blocks.where("words is null").select("block", "key", "places")
    return documents.groupBy("block").cogroup(back.groupBy("own_block")).applyInArrow(_assemble, "key long, ids array<int>, n long")


def encode_texts(df: DataFrame, key: str, text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_words: int = BLOCK_WORDS, word_blocks: int = WORD_BLOCKS) -> DataFrame:
    """(key, ids): the token ids of each row's text, as it stands, without special tokens.

    NULL and empty texts have an empty list. Rows are kept one by one: repeated rows and NULL or
    repeated keys come out as often as they come in. A text of any length lies in one block.
    """
    return _encoded(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), tokenizers, vocabulary, block_words, word_blocks).select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, key: str, text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_tokens): the number of tokens of each row's text; 0 for NULL and empty ones."""
    return _encoded(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), tokenizers, vocabulary, block_words).select(F.col("key").alias(key), F.col("n").alias("n_tokens"))


def token_table(spark, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, bytes): the vocabulary file as a table, as many rows as the vocabulary has tokens."""
    lines = spark.read.text(f"file://{tokenizers}/{vocabulary}")
    parts = F.split("value", " ")
    return lines.where("value <> ''").select(parts[1].cast("int").alias("id"), F.unbase64(parts[0]).alias("bytes"))


def _join_bytes(tokens: pa.BinaryArray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            offsets = ids.offsets.to_numpy()
            pieces = tokens.take(ids.values.slice(offsets[0], offsets[-1] - offsets[0]))
            lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pieces)
            whole = pc.binary_join(lists, b"").to_pylist()
            out = [t.decode("utf-8", "replace") if there else None for t, there in zip(whole, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.string())], names=["key", "text"])

    return run


def decode_ids(df: DataFrame, key: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of (key, ids): the ids joined with the token-byte table, the bytes put together by position.

    The table has as many rows as the vocabulary, whatever the size of the corpus, so it goes to every
    worker and the join is by place in an array: nothing is shuffled. NULL ids give NULL, an empty list
    ''; bytes that aren't UTF-8 become U+FFFD. An id that the vocabulary doesn't have is an error.
    """
    table = token_table(df.sparkSession, tokenizers, vocabulary).toArrow().sort_by("id")
    if table.column("id").to_pylist() != list(range(len(table))):
        raise ValueError(f"the ids of {vocabulary} aren't 0 to {len(table) - 1}")
    tokens = table.column("bytes").combine_chunks()
    tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
    return df.select(F.col(key).cast("long").alias("key"), "ids").mapInArrow(_join_bytes(tokens), "key long, text string").withColumnRenamed("key", key)
