"""Evaluation passages in training text: Wu-Manber search over words.

The patterns are all runs of ``passage`` consecutive words of all items, so every pattern
has the same length. A shift table over blocks of ``BLOCK`` words tells how far the window
may move when its last block is read: a block of no pattern moves it past the block. Where
the shift is 0, the bucket of the window's last block names the patterns to compare word
by word, first by the words' hashes, then by their letters. Many texts are searched side by
side, one lane each, as numpy arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralmill.llm.words import _IS_WORD, located_words, slices

BLOCK = 6
TABLE_BITS = 20
LANE = 2048
ITEM_BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[a-z0-9]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class PassageIndex:
    """Shift table and buckets of one block of items."""

    def __init__(self, item_ids: list[int], texts: list[str | None], passage: int):
        self.passage, self.block = passage, min(BLOCK, passage)
        self.item_ids = np.asarray(item_ids, np.int64)
        self.data, self.words, self.starts, bounds = located_words(pa.array(texts, pa.large_string()))
        lengths = np.diff(bounds)
        self.skip = passage - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, self.skip, np.int32)
        ends, owner, within = [], [], []
        for k in np.flatnonzero(lengths >= passage):
            inner = np.arange(self.block - 1, lengths[k])
            ends.append(bounds[k] + inner)
            within.append(inner)
            owner.append(np.full(len(inner), k))
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        within = np.concatenate(within) if within else np.zeros(0, np.int64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        codes = self.codes(self.words, ends)
        np.minimum.at(self.shift, self.slot(codes), np.maximum(0, passage - 1 - within).astype(np.int32))
        full = within >= passage - 1
        order = np.argsort(codes[full], kind="stable")
        self.bucket_code, self.pattern_end, self.pattern_item = codes[full][order], ends[full][order], owner[full][order]

    def codes(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        code = np.zeros(len(ends), np.uint64)
        for back in range(self.block):
            code += words[ends - back] * _MIX[back]
            code ^= code >> np.uint64(29)
        return code

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def spelled(self, data: np.ndarray, starts: np.ndarray, end: int) -> list[bytes]:
        """The letters of the passage of which the last word is number ``end``."""
        first = int(starts[end - self.passage + 1])
        last = int(starts[end])
        stop = int(starts[end + 1]) if end + 1 < len(starts) else len(data)  # the next text may begin with a word
        while last < stop and _IS_WORD[data[last]]:
            last += 1
        return _WORD.findall(data[first:last].tobytes().lower())[: self.passage]

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) index pairs, each once, of texts that hold a pattern."""
        data, words, starts, bounds = located_words(texts)
        m = self.passage
        none = np.zeros(0, np.int64)
        if len(self.pattern_end) == 0 or len(words) < m:
            return none, none
        sizes = np.diff(bounds)
        lanes = np.maximum(0, -(-(sizes - m + 1) // LANE))  # a lane has LANE window positions
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = bounds[:-1][text] + nth * LANE + m - 1
        stop = np.minimum(at + LANE, bounds[1:][text])
        found: set[tuple[int, int]] = set()
        while len(at):
            code = self.codes(words, at)
            move = self.shift[self.slot(code)]
            hit = np.flatnonzero(move == 0)
            if len(hit):
                lo = np.searchsorted(self.bucket_code, code[hit], "left")
                size = np.searchsorted(self.bucket_code, code[hit], "right") - lo
                total = int(size.sum())
                if total:
                    # buckets are compared in bounded pieces
                    edges = np.concatenate(([0], np.cumsum(size)))
                    for begin in range(0, total, 1 << 16):
                        flat = np.arange(begin, min(total, begin + (1 << 16)))
                        row = np.searchsorted(edges, flat, "right") - 1
                        pattern = lo[row] + flat - edges[row]
                        here, there = at[hit[row]], self.pattern_end[pattern]
                        same = np.ones(len(flat), bool)
                        for back in range(m):
                            same &= words[here - back] == self.words[there - back]
                        for k in np.flatnonzero(same):  # rare, and a pair that is confirmed isn't looked at again
                            pair = int(text[hit[row[k]]]), int(self.pattern_item[pattern[k]])
                            if pair not in found and self.spelled(data, starts, int(here[k])) == self.spelled(self.data, self.starts, int(there[k])):
                                found.add(pair)
            at = at + np.maximum(1, move)
            open_ = at < stop
            at, stop, text = at[open_], stop[open_], text[open_]
        if not found:
            return none, none
        pairs = np.array(sorted(found), np.int64)
        return pairs[:, 0], pairs[:, 1]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            for begin, end in slices(texts):
                text, item = index.search(texts.slice(begin, end - begin))
                if len(text):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + begin)), pa.array(index.item_ids[item])], names=["doc_id", "item_id"])

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
        if held >= ITEM_BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(documents: DataFrame, items: DataFrame, passage: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents that share ``passage`` consecutive words with an item.

    Whole texts are searched. Null and empty texts, texts of fewer words, and rows with a
    null id give nothing; repeated rows give one pair. The items go to the executors in
    blocks of at most ``ITEM_BLOCK_BYTES`` characters (one longer item is a block of its
    own), with one pass over the documents for each block. Other columns are ignored.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and length(text) > 0")
    result = None
    for ids, texts in _blocks(items.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(item_id).isNotNull() & F.col(text).isNotNull())):
        shared = spark.sparkContext.broadcast(PassageIndex(ids, texts, passage))
        found = source.mapInArrow(_search(shared), "doc_id bigint, item_id bigint")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return result.distinct()
