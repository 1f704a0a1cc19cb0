"""Evaluation texts inside a corpus: exact pieces by pigeonhole, verified by bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import grams, word_hashes
from strandlake.operators.suffixes import running_offsets
from strandlake.session import cut_lineage, spread

#: Characters of evaluation text that one pass over the corpus takes; more texts take more passes.
BLOCK_CHARS = 16_000_000
#: Characters from which a single evaluation text is taken in several stretches.
ITEM_CHARS = 4_000_000
#: Candidates that are verified at once.
AT_ONCE = 200_000

FOUND = "doc long, item long, distance int"


class Pieces:
    """The pieces of every window of the evaluation texts: each window of `window` words is cut into
    budget + 1 runs of words, one of which survives any `budget` edits of a word."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int) -> None:
        self.window, self.budget = window, budget
        cuts = [window * k // (budget + 1) for k in range(budget + 2)]
        self.parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        blocks = list(word_hashes([t for _, t in items]))
        self.words = np.concatenate([b[0] for b in blocks]) if blocks else np.zeros(0, np.uint64)
        own = np.concatenate([b[1] for b in blocks]) if blocks else np.zeros(0, np.int64)
        self.item = np.array([i for i, _ in items], np.int64)[own] if len(own) else np.zeros(0, np.int64)
        n = max(0, len(own) - window + 1)
        starts = np.flatnonzero(own[:n] == own[window - 1 : window - 1 + n])
        self.tables = []
        for length in sorted({b - a for a, b in self.parts}):
            hashes = grams(self.words, length)
            keys, places = [], []
            for a, b in self.parts:
                if b - a == length and len(starts):
                    keys.append(hashes[starts + a])
                    places.append(np.stack([starts, np.full(len(starts), a)], 1))
            if keys:
                key, place = np.concatenate(keys), np.concatenate(places)
                order = np.argsort(key, kind="stable")
                unique, first = np.unique(key[order], return_index=True)
                maybe = np.zeros(1 << 20, bool)
                maybe[unique & np.uint64((1 << 20) - 1)] = True
                self.tables.append((length, unique, np.append(first, len(key)), place[order], maybe))

    def candidates(self, words: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, start of the window in `words`, start of the window in the items) of exact piece hits."""
        for length, unique, first, place, maybe in self.tables:
            h = grams(words, length)
            at = np.flatnonzero(maybe[h & np.uint64(len(maybe) - 1)])
            k = np.minimum(np.searchsorted(unique, h[at]), len(unique) - 1)
            hit = (unique[k] == h[at]) & (own[at] == own[at + length - 1])
            at, k = at[hit], k[hit]
            many = first[k + 1] - first[k]
            ends = np.cumsum(many)
            low = 0
            while low < len(at):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
                n = many[low:high]
                rows = np.repeat(first[k[low:high]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                spot = place[rows]
                found = np.repeat(at[low:high], n)
                yield own[found], found - spot[:, 1], spot[:, 0]
                low = high

    def possible(self, words: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The candidates of which all but `budget` words of the window stand within `budget` places of
        where they should: no other can be within the distance."""
        e, last = self.budget, len(words) - 1
        left, missed = np.arange(len(at)), np.zeros(len(at), np.int8)
        for k in range(self.window):
            word, place = self.words[start[left] + k], at[left] + k
            near = np.zeros(len(left), bool)
            for j in range(-e, e + 1):
                near |= words[np.clip(place + j, 0, last)] == word
            missed = missed + ~near
            ok = missed <= e
            left, missed = left[ok], missed[ok]
        return left

    def distances(self, words: np.ndarray, own: np.ndarray, text: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The least edit distance, in words, of item windows to any stretch of `text` near `at`: Myers'
        bit-parallel recurrence with one bit a word of the window, over all candidates at once."""
        m, e = self.window, self.budget
        one = np.uint64(1)
        full, top = np.uint64((1 << m) - 1), np.uint64(m - 1)
        pattern = [self.words[start + k] for k in range(m)]
        pv, mv = np.full(len(at), full, np.uint64), np.zeros(len(at), np.uint64)
        score, best = np.full(len(at), m, np.int32), np.full(len(at), m, np.int32)
        for j in range(-e, m + e):
            pos = at + j
            inside = (pos >= 0) & (pos < len(words))
            safe = np.clip(pos, 0, len(words) - 1)
            inside &= own[safe] == text
            word = words[safe]
            eq = np.zeros(len(at), np.uint64)
            for k in range(m):
                eq |= (pattern[k] == word).astype(np.uint64) << np.uint64(k)
            eq[~inside] = 0
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = (mv | ~(xh | pv)) & full, pv & xh & full
            score += ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32)
            ph, mh = (ph << one) & full, (mh << one) & full
            pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
            best = np.minimum(best, score)
        return best

    def search(self, ids: list[int], texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, least distance) of each pair within the budget."""
        ids_of = np.asarray(ids, np.int64)
        for words, own in word_hashes(texts):
            near: list[np.ndarray] = []
            with np.errstate(over="ignore"):
                for text, at, start in self.candidates(words, own):
                    some = self.possible(words, at, start)
                    text, at, start = text[some], at[some], start[some]
                    d = self.distances(words, own, text, at, start)
                    ok = np.flatnonzero(d <= self.budget)
                    near.append(np.stack([text[ok], self.item[start[ok]], d[ok]], 1))
            if near:
                rows = np.concatenate(near)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
                rows = rows[new]
                if len(rows):
                    yield ids_of[rows[:, 0]], rows[:, 1], rows[:, 2]


def _scan(pieces: Pieces) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, item, distance in pieces.search(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(item), pa.array(distance.astype(np.int32))], ["doc", "item", "distance"])

    return run


def _stretches(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Evaluation texts, long ones in stretches that share window - 1 words, so that no window is lost."""

    def cut(text: str) -> Iterator[str]:
        low = 0
        while len(text) - low > ITEM_CHARS:
            high = low + ITEM_CHARS
            while high < len(text) and (text[high].isalnum() or text[high - 1].isalnum()):
                high += 1
            yield text[low:high]
            back, at = high, 0
            while at < window - 1 and back > low + 1:
                back -= 1
                at += text[back].isalnum() and not text[back - 1].isalnum()
            low = back
        yield text[low:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                for part in cut(text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([part])], ["id", "text"])

    return run


def _item_blocks(tests: DataFrame, window: int) -> Iterator[list[tuple[int, str]]]:
    """The evaluation texts in blocks of BLOCK_CHARS characters, of which the last text may stick out."""
    rows = tests.mapInArrow(_stretches(window), "id long, text string")
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size <= BLOCK_CHARS:
        yield [tuple(r) for r in rows.collect()]
        return
    numbered = cut_lineage(rows.withColumn("n", F.monotonically_increasing_id()))
    placed = cut_lineage(running_offsets(numbered, "n", {"before": F.char_length("text")}).select((F.col("before") / BLOCK_CHARS).cast("int").alias("block"), "id", "text"))
    for k in range(-(-size // BLOCK_CHARS)):
        yield [tuple(r) for r in placed.where(F.col("block") == k).select("id", "text").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, window: int = 12, budget: int = 1) -> DataFrame:
    """(`doc_id`, `item_id`, `distance`) of each document that holds a passage of an evaluation text: some
    `window` consecutive words of it with at most `budget` words changed, put in or left out; `distance`
    is the least number of such edits, so 0 means `window` consecutive words in common.

    Words are the longest runs of Unicode letters and digits in lower-cased text, compared as 64-bit
    hashes. Every window of every item is cut into budget + 1 pieces, one of which must stand unchanged in
    the text; every position of every document is looked up among the pieces, and each hit is verified.
    The pieces of at most BLOCK_CHARS + ITEM_CHARS characters of items are sent to the workers at a time; a
    larger set of items is taken in blocks, each with its own pass over the corpus. Documents are not shuffled, unless they
    come in fewer partitions than there are cores.

    Null ids are left out; null and empty texts, and items of fewer than `window` words, hold nothing.
    Repeated rows and several hits of one pair give one row. Without documents or items there are no rows.
    Other columns are ignored, whatever their names.
    """
    if not 0 <= budget < window <= 64:
        raise ValueError("0 <= budget < window <= 64 is needed")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    source = spread(source)
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    found = spark.createDataFrame([], FOUND)
    for block in _item_blocks(tests, window):
        if block:
            found = found.union(source.mapInArrow(_scan(Pieces(block, window, budget)), FOUND))
    best = found.groupBy("doc", "item").agg(F.min("distance").alias("distance"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "distance")
