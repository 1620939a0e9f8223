"""Encoding of a corpus with a public byte-level BPE tokenizer through a distinct-word table.

A byte-level BPE encodes every word of its splitting pattern by itself, so
 1. the texts are split into words by Spark's regular expressions;
 2. runs of documents (blocks) replace their words by positions in the block's
    own list of distinct words, and both are written: the documents as arrays of
    positions, the lists as (block, position, word);
 3. each distinct word of the corpus is encoded once, and its ids are joined back
    to the lists by word and to the documents by block and position.
No text is shuffled, only positions; no list of all words is held anywhere.
Decoding joins every id to its piece of the vocabulary, which is of fixed size.

Defined results: null and empty texts have an empty list of ids; special tokens
are never produced, their strings in a text are ordinary text; repeated document
ids stay separate rows; an empty table gives an empty result; other columns of
the input are ignored. Texts with code points that this Java does not know as
assigned are one word, split by the tokenizer itself, which may know them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.session import materialize

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a block of documents, apart from a longer single document.
BLOCK_WORDS = 2_000_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def load_encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def split_words(text: Column) -> Column:
    """The words of ``text`` in order; they join to the text again."""
    words = F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))
    return F.when(text.rlike(r"\p{Cn}"), F.array(text)).otherwise(words)


_BLOCKED = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("words", pa.list_(pa.int32())), ("pos", pa.int32()), ("word", pa.string())])


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start, ends = 0, np.cumsum(lengths)
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_WORDS, side="right")))
        yield start, stop
        start = stop


def _to_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        docs, lists = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        for start, stop in _slices(lengths):
            part = lists.slice(start, stop - start)
            coded = part.flatten().dictionary_encode()
            n = stop - start
            offsets = np.concatenate(([0], np.cumsum(lengths[start:stop]))).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(offsets), coded.indices.cast(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), docs.slice(start, n), positions, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_BLOCKED
            )
            m = len(coded.dictionary)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(np.arange(m, dtype=np.int32)), coded.dictionary],
                    schema=_BLOCKED,
                )
            block += 1


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = load_encoding(path).encode_ordinary
        for batch in batches:
            ids = [encode_one(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return encode


def _dictionary(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in the flat ids, by position."""
    lists = right.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    at = right.column("pos").to_numpy()
    by_pos, by_len = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    by_pos[at], by_len[at] = starts, lengths
    return flat, by_pos, by_len


def _words_of(left: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = left.column("words").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _join_ids(left: pa.Table, right: pa.Table) -> pa.Table:
    flat, starts, lengths = _dictionary(right)
    words, per_doc = _words_of(left)
    n = lengths[words] if len(words) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(starts[words] - (ends - n), n) if total else np.zeros(0, np.int64)
    bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_doc)))]
    ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[index].astype(np.int32)))
    return pa.table({"doc": left.column("doc"), "ids": ids})


def _join_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    _, _, lengths = _dictionary(right)
    words, per_doc = _words_of(left)
    ends = np.concatenate(([0], np.cumsum(lengths[words] if len(words) else np.zeros(0, np.int64))))
    bounds = np.concatenate(([0], np.cumsum(per_doc)))
    return pa.table({"doc": left.column("doc"), "tokens": pa.array(np.diff(ends[bounds]).astype(np.int64))})


def _blocked(docs: DataFrame, id_col: str, text_col: str, ranks: str) -> tuple[DataFrame, DataFrame]:
    split = docs.select(F.col(id_col).cast("long").alias("doc"), split_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    blocked = materialize(split.mapInArrow(_to_positions, "block long, doc long, words array<int>, pos int, word string"), "blocks")
    lists = blocked.filter("word IS NOT NULL").select(F.col("block").alias("list"), "pos", "word")
    table = lists.select("word").distinct().mapInArrow(_encoder(ranks), "word string, ids array<int>")
    return blocked.filter("word IS NULL").select("block", "doc", "words"), lists.join(table, "word").select("list", "pos", "ids")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, ids) of every row of ``docs``."""
    left, right = _blocked(docs, id_col, text_col, ranks)
    out = left.groupBy("block").cogroup(right.groupBy("list")).applyInArrow(_join_ids, "doc long, ids array<int>")
    return out.withColumnRenamed("doc", id_col)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, tokens) of every row of ``docs``: the number of its ids."""
    left, right = _blocked(docs, id_col, text_col, ranks)
    out = left.groupBy("block").cogroup(right.groupBy("list")).applyInArrow(_join_counts, "doc long, tokens long")
    return out.withColumnRenamed("doc", id_col)


#: Tokens that are decoded in one row.
DECODED = 4096


def vocabulary(like: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, piece in hexadecimal digits) of the vocabulary, whose size is fixed."""
    rows = [(i, piece.hex()) for piece, i in load_ranks(ranks).items()]
    return like.sparkSession.createDataFrame(rows, "id int, piece string")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, text): the pieces of every list of ids, put together; an empty list gives an empty text.

    Each list is one row of the input with an id of its own. Ids outside the
    vocabulary have no piece and are left out. Pieces are put together in runs of
    DECODED, then the runs, so that no task gathers the tokens of a long text one by one.
    """
    exploded = encoded.select(F.col(id_col), F.posexplode(ids_col).alias("at", "id")).withColumn("run", F.floor(F.col("at") / DECODED))
    pieces = exploded.join(F.broadcast(vocabulary(encoded, ranks)), "id")
    put = lambda order, what: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, what))), lambda x: x[what]), "")
    runs = pieces.groupBy(id_col, "run").agg(put("at", "piece").alias("part"))
    texts = runs.groupBy(id_col).agg(put("run", "part").alias("whole")).select(id_col, F.decode(F.unhex("whole"), "UTF-8").alias("text"))
    return encoded.select(id_col).join(texts, id_col, "left").select(id_col, F.coalesce("text", F.lit("")).alias("text"))
