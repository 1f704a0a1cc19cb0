"""Filling fixed-capacity containers with texts, measured in tokens, by bounded-space packing."""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import cut_lineage, spread

# Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Rows of the container table that are read at most; it is a list of settings, not data.
MAX_KINDS = 1_000
#: Distinct words whose token counts a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Longer words are counted each time.
LONG_WORD = 64

PLACED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("bin", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("token_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("open", T.BooleanType()),
    ]
)
MOVED = T.StructType([*(PLACED[c] for c in ("kind", "capacity", "bin")), T.StructField("fill", T.LongType()), T.StructField("to", T.LongType()), PLACED["open"]])

_SPACES = re.compile(r" \s|\s ")
_loaded: dict[str, TokenCounts] = {}


class TokenCounts(dict):
    """Token counts of texts under one vocabulary, with those of words that were met before.

    A single space between two other characters always starts a new piece of the pattern, so the
    tokens of a text without other white space next to a space are those of its words, each with the
    space before it.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if text[0] == " " or text[-1] == " " or _SPACES.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        return len(self.encode(first)) + sum(map(self.__getitem__, rest))


def token_counts(path: str) -> TokenCounts:
    """One for each worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = TokenCounts(path)
    return _loaded[path]


class OpenBins:
    """At most `most` open bins of one capacity; each item goes where it leaves the least room."""

    def __init__(self, capacity: int, most: int, numbers: Iterator[int]) -> None:
        self.capacity, self.most, self.numbers = capacity, most, numbers
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def put(self, size: int, item: tuple) -> Iterator[tuple[int, list]]:
        """Bins that are closed by it: full ones, and the fullest when no open bin takes the item."""
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, bin_no = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                _, fullest = self.rooms.pop(0)
                yield fullest, self.held.pop(fullest)
            room, bin_no = self.capacity, next(self.numbers)
            self.held[bin_no] = []
        self.held[bin_no].append(item)
        if room > size:
            insort(self.rooms, (room - size, bin_no))
        else:
            yield bin_no, self.held.pop(bin_no)

    def rest(self) -> Iterator[tuple[int, list]]:
        for _, bin_no in self.rooms:
            yield bin_no, self.held[bin_no]


def _numbers(stage: int) -> Iterator[int]:
    """Bin numbers that no other task of any stage gives."""
    part = TaskContext.get().partitionId()
    at = (stage << 58) | (part << 34)
    while True:
        yield at
        at += 1


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema.fields, strict=True)], schema.names)


def _pack(kinds: list[tuple[str, int]], path: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, numbers = token_counts(SparkFiles.get(os.path.basename(path))).count, _numbers(0)
        bins = [OpenBins(capacity, most, numbers) for _, capacity in kinds]
        out: list[tuple] = []
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = count(text.as_py())
                for (kind, capacity), own in zip(kinds, bins, strict=True):
                    if not n:
                        out.append((kind, capacity, None, i, 0, 0, 0, False))
                        continue
                    whole = n // capacity if n > capacity else 0
                    out += [(kind, capacity, next(numbers), i, k, k * capacity, capacity, False) for k in range(whole)]
                    rest = n - whole * capacity
                    if rest:
                        for bin_no, items in own.put(rest, (i, whole, whole * capacity, rest)):
                            out += [(kind, capacity, bin_no, *x, False) for x in items]
                if len(out) >= 50_000:
                    yield _table(out, PLACED)
                    out = []
        for (kind, capacity), own in zip(kinds, bins, strict=True):
            for bin_no, items in own.rest():
                out += [(kind, capacity, bin_no, *x, True) for x in items]
        if out:
            yield _table(out, PLACED)

    return run


def _merge(stage: int, most: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Put half-filled bins together, fullest first; rows must come sorted by kind and capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, own, open_kind = _numbers(stage), None, None
        out: list[tuple] = []

        def closed(bins: Iterator[tuple[int, list]], still: bool) -> None:
            for to, items in bins:
                out.extend((*open_kind, bin_no, fill, to, still) for bin_no, fill in items)

        for b in batches:
            for kind, capacity, bin_no, fill in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if (kind, capacity) != open_kind:
                    if own:
                        closed(own.rest(), not last)
                    own, open_kind = OpenBins(capacity, most, numbers), (kind, capacity)
                closed(own.put(fill, (bin_no, fill)), False)
            if out:
                yield _table(out, MOVED)
                out.clear()
        if own:
            closed(own.rest(), not last)
        if out:
            yield _table(out, MOVED)

    return run


def pack_texts(docs: DataFrame, containers: DataFrame, idx: str, text: str, kind: str = "container_kind", capacity: str = "capacity", vocabulary: str = VOCABULARY, open_bins: int = 64, fan_in: int = 64) -> DataFrame:
    """Place every text whole into a container of each kind: `container_kind`, `capacity`, `container_id`,
    `idx`, `piece_no`, `token_start`, `n_tokens`.

    Each partition counts tokens and keeps at most `open_bins` containers of a kind open. A text goes into
    the open one that it leaves with least room; when none takes it, the fullest is closed. What is still
    open at the end of a partition is merged, `fan_in` partitions at a time, in as many rounds as it takes;
    no task ever sees more than open_bins x fan_in leftovers of a kind. The first placing is written to the
    checkpoint folder, so tokens are counted once. `vocabulary` is a file of the driver's machine; it is sent
    to the workers.

    Only a text longer than the capacity is cut: into full containers and one remainder, which is placed
    like a text. `token_start` is where a piece begins in its text. Null and empty texts hold no token; they
    come out with `n_tokens` 0 and a null `container_id`. Null ids are placed too, repeated rows each count.
    Kinds with a null or non-positive capacity are left out, repeated kinds count once; without texts or
    kinds there are no rows. Other columns are ignored, whatever their names.
    """
    rows = containers.select(F.col(kind).cast("string"), F.col(capacity).cast("int")).where(F.col(capacity) > 0).distinct().limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    kinds = sorted((tuple(r) for r in rows), key=lambda r: (r[0] or "", r[1]))
    source = spread(docs.select(F.col(idx).cast("long").alias("id"), F.col(text).alias("text")))
    docs.sparkSession.sparkContext.addFile(vocabulary)
    parts = max(1, source.rdd.getNumPartitions())
    placed = cut_lineage(source.mapInArrow(_pack(kinds, vocabulary, open_bins), PLACED))
    done = placed.where("NOT open").select("kind", "capacity", F.col("bin").alias("to"), "id", "piece_no", "token_start", "n_tokens")
    half = placed.where("open")
    left = half.groupBy("kind", "capacity", "bin").agg(F.sum("n_tokens").alias("fill"))
    path: DataFrame | None = None
    stage = 0
    while True:
        parts, stage = -(-parts // fan_in), stage + 1
        sorted_left = left.repartition(parts, "bin").sortWithinPartitions("kind", "capacity", F.col("fill").desc(), "bin")
        moved = cut_lineage(sorted_left.mapInArrow(_merge(stage, open_bins, parts == 1), MOVED))
        step = moved.select("bin", "to")
        path = step if path is None else path.join(step.toDF("to", "_next"), "to", "left").select("bin", F.coalesce("_next", "to").alias("to"))
        if parts == 1:
            break
        left = moved.where("open").groupBy("kind", "capacity", F.col("to").alias("bin")).agg(F.sum("fill").alias("fill"))
    merged = half.join(path, "bin").select("kind", "capacity", "to", "id", "piece_no", "token_start", "n_tokens")
    names = [kind, capacity, "container_id", idx, "piece_no", "token_start", "n_tokens"]
    return done.unionByName(merged).toDF(*names)
