"""Long exact spans shared between records, from fixed-block anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.session import cut_lineage, lookup_join, spread

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE_2, _MIX_2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB)

BLOCKS = "hash long, id long, pos int"
SETS = "bucket int, deltas binary, block binary, again binary"
SPANS = "span binary, id long, pos int"
#: Windows of a task whose hashes are sorted together, and windows that share a bucket.
AT_ONCE, BUCKET = 4_000_000, 4_000_000
#: Characters of records that are hashed together.
CHARS = 1_000_000
#: Buckets at most, for their numbers share a word with BITS bits; beyond, buckets hold more windows.
MOST_BUCKETS = 1 << 22
#: Bits of a hash that tell windows of a bucket apart. Windows that they confuse only make more candidates.
BITS = 40


def _letters(text: str) -> np.ndarray:
    """One number a character."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _joined(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, letters, starts and lengths of the texts in them) of texts that are taken
    together, of CHARS characters unless one alone has more."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = lengths.cumsum()
    low = 0
    while low < len(lengths):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + CHARS, "right")))
        yield low, _letters("".join(texts.slice(low, high - low).to_pylist())), ends[low:high] - lengths[low:high] - before, lengths[low:high]
        low = high


def _places(starts: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in it) of every window of `k` characters that lies within a text."""
    many = np.maximum(lengths - k + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    return text, np.arange(len(text)) - np.repeat(many.cumsum() - many, many)


def rolling(codes: np.ndarray, k: int, base: np.uint64 = _BASE, mix: np.uint64 = _MIX) -> np.ndarray:
    """A 64-bit hash of every window of `k` characters, by doubling the window length."""
    with np.errstate(over="ignore"):
        level = (codes.astype(np.uint64) + np.uint64(1)) * mix
        level ^= level >> np.uint64(29)
        n, out, done, rest = len(codes), None, 0, k
        width = 1
        while rest:
            if rest & 1:
                piece = level[done : done + n - k + 1]
                out = piece.copy() if out is None else out * base + piece
                done += width
            rest >>= 1
            if rest:
                level = level[: len(level) - width] * base + level[width:]
                base, width = base * base, width * 2
        out = (out ^ (out >> np.uint64(31))) * mix
        return (out ^ (out >> np.uint64(30))).view(np.int64)


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, in the high bits, and BITS of the hash itself."""
    h = hashes.view(np.uint64)
    return (h >> np.uint64(BITS)) % np.uint64(buckets) << np.uint64(BITS) | h & np.uint64((1 << BITS) - 1)


def _blocks(k: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of `k` characters that lie one behind the other from a record's first character on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, letters, starts, lengths in _joined(b.column(1)):
                text, block = _places(starts, lengths // k, 1)
                keys = _keys(rolling(letters, k)[starts[text] + block * k], buckets)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), ids[first + text], (block * k).astype(np.int32))], ["hash", "id", "pos"])

    return run


def _sets(hashes: list[np.ndarray], is_block: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """The different windows of some records by bucket: their hashes in order, as steps from one to the next;
    whether a block is among the windows of a hash, and whether it has more than one."""
    rows = _keys(np.concatenate(hashes), buckets) << np.uint64(1) | ~np.concatenate(is_block) * np.uint64(1)
    rows.sort()
    keys = rows >> np.uint64(1)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    again = np.diff(first, append=len(keys)) > 1
    block, keys = rows[first] & np.uint64(1) == 0, keys[first]
    bucket = (keys >> np.uint64(BITS)).astype(np.int32)
    own = np.unique(bucket)
    out: list[list] = [[], [], []]
    for low, high in zip(np.searchsorted(bucket, own, "left"), np.searchsorted(bucket, own, "right"), strict=True):
        steps = np.diff(keys[low:high] & np.uint64((1 << BITS) - 1), prepend=np.uint64(0))
        # Byte by byte over all steps, for the high bytes are mostly 0 and compress well.
        out[0].append(steps.view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T.tobytes())
        out[1].append(np.packbits(block[low:high]).tobytes())
        out[2].append(np.packbits(again[low:high]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "deltas", "block", "again"])


def _probes(k: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every rolling window of `k` characters as its hash, in sets of AT_ONCE windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, is_block, held = [], [], 0
        for b in batches:
            for _, letters, starts, lengths in _joined(b.column(0)):
                text, place = _places(starts, lengths, k)
                hashes.append(rolling(letters, k)[starts[text] + place])
                is_block.append(place % k == 0)
                held += len(place)
                if held >= AT_ONCE:
                    yield _sets(hashes, is_block, buckets)
                    hashes, is_block, held = [], [], 0
        if held:
            yield _sets(hashes, is_block, buckets)

    return run


def _met(key: tuple, sets: pa.Table) -> pa.Table:
    """The hashes of one bucket that belong to a block and to another window."""
    keys, block, again = [], [], []
    for steps, blocks, agains in zip(*(sets.column(c).to_pylist() for c in ("deltas", "block", "again")), strict=True):
        bytes_ = np.frombuffer(steps, np.uint8).reshape(BITS // 8, -1)
        wide = np.zeros((bytes_.shape[1], 8), np.uint8)
        wide[:, : BITS // 8] = bytes_.T
        keys.append(np.cumsum(wide.view(np.uint64).ravel()))
        for out, bits in ((block, blocks), (again, agains)):
            out.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(wide)).astype(bool))
    # The flags ride along in the lowest bits, so that the hashes are sorted as they are.
    rows = np.concatenate(keys) << np.uint64(2) | np.concatenate(block) * np.uint64(2) | np.concatenate(again) * np.uint64(1)
    rows.sort()
    hashes = rows >> np.uint64(2)
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    flags = np.bitwise_or.reduceat(rows & np.uint64(3), first)
    many = (np.diff(first, append=len(rows)) > 1) | (flags & np.uint64(1) > 0)
    found = hashes[first[many & (flags & np.uint64(2) > 0)]] | np.uint64(key[0].as_py()) << np.uint64(BITS)
    return pa.table([pa.array(found.view(np.int64))], ["hash"])


def _candidates(length: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of `length` characters that hold an anchor of the record, each once, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, anchors = b.column(0).to_numpy(), b.column(2)
            many = pc.list_value_length(anchors).to_numpy(zero_copy_only=False)
            flat, ends = anchors.flatten().to_numpy().astype(np.int64), many.cumsum()
            for first, letters, starts, lengths in _joined(b.column(1)):
                count = len(starts)
                own = np.repeat(np.arange(count), many[first : first + count])
                at = flat[ends[first] - many[first] : ends[first + count - 1]]
                low, high = np.maximum(at - (length - k), 0), np.minimum(at, lengths[own] - length)
                steps = np.zeros(len(letters) + 2, np.int32)
                np.add.at(steps, (starts[own] + low)[low <= high], 1)
                np.add.at(steps, (starts[own] + high + 1)[low <= high], -1)
                new = np.flatnonzero(steps.cumsum() > 0)
                if not len(new):
                    continue
                text = np.searchsorted(starts, new, "right") - 1
                wide = np.stack([rolling(letters, length, base, mix)[new] for base, mix in ((_BASE, _MIX), (_BASE_2, _MIX_2))], 1)
                for part in range(0, len(new), 200_000):
                    some = slice(part, part + 200_000)
                    data = pa.py_buffer(np.ascontiguousarray(wide[some]))
                    span = pa.Array.from_buffers(pa.binary(16), len(new[some]), [None, data]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([span, pa.array(ids[first + text[some]]), pa.array((new[some] - starts[text[some]]).astype(np.int32))], ["span", "id", "pos"])

    return run


def shared_windows(df: DataFrame, idx: str, text: str, length: int) -> DataFrame:
    """(`id`, `pos`) of every window of `length` characters that another record also holds.

    Of every record the non-overlapping blocks of half the length are indexed; any span of `length`
    characters holds one of them whole. Every rolling window of a block's length probes the index, as its
    hash alone, counted within the task before it is shuffled. A block whose content is met by another
    window than itself is an anchor. Anchors are extended to all windows of `length` around them, which are
    compared by two independent 64-bit hashes: by grouping on them, so that copies of one record, or a
    repeat in a third of all records, become one row per partition, and no pairs are formed. Adjoining
    windows make up the maximal repeats. Blocks and windows that stand in very many places do not move: the
    few rows that they are looked up in are broadcast.
    """
    k = (length + 1) // 2
    rows = spread(df.select(F.col(idx).cast("long").alias("id"), F.col(text).alias("text")).where(f"id IS NOT NULL AND char_length(text) >= {length}"))
    n, n_blocks = rows.agg(F.sum(F.char_length("text")), F.sum(F.floor(F.char_length("text") / k))).first()
    buckets = min(MOST_BUCKETS, max(df.sparkSession.sparkContext.defaultParallelism, -(-(n or 0) // BUCKET)))
    met = rows.select("text").mapInArrow(_probes(k, buckets), SETS).groupBy("bucket").applyInArrow(_met, "hash long")
    anchors = lookup_join(rows.mapInArrow(_blocks(k, buckets), BLOCKS), met, "hash", n_blocks or 0, "left_semi")
    places = anchors.groupBy("id").agg(F.collect_set("pos").alias("at"))
    windows = cut_lineage(rows.join(places, "id").select("id", "text", "at").mapInArrow(_candidates(length, k), SPANS))
    shared = windows.groupBy("span").agg((F.min("id") < F.max("id")).alias("two")).where("two").select("span")
    return lookup_join(windows, shared, "span", windows.count(), "left_semi").select("id", "pos")


def shared_lengths(df: DataFrame, idx: str, text: str, length: int = 32, id_name: str = "protein_idx") -> DataFrame:
    """(`id_name`, `shared_len`): of each record, the number of characters in spans of at least `length`
    consecutive ones that stand letter for letter in a record with another id, each counted once.
    Letters are told apart by 128 bits of a span's hash.

    Only rows above 0. A repeat within one record, or in rows of one id, does not count. Null ids and
    null, empty or short texts share nothing. Ids must be unique for the lengths to be of one text; the
    texts of a repeated id count together. An empty table gives no rows; other columns are ignored.
    """
    at = shared_windows(df, idx, text, length)
    after = F.lead("pos").over(Window.partitionBy("id").orderBy("pos"))
    own = at.select("id", F.least(F.lit(length), F.coalesce(after - F.col("pos"), F.lit(length))).alias("new"))
    return own.groupBy(F.col("id").alias(id_name)).agg(F.sum("new").cast("long").alias("shared_len"))
