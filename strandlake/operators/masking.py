"""Masking of low-complexity stretches in query residues."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.alphabet import STANDARD, STANDARD_INTERNAL
from strandlake.session import spread

# Fixed values of the masking method: window, entropies in bits that start and bound a stretch, and the
# most residues by which a stretch is trimmed.
WINDOW, TRIGGER, BOUND, MOST_TRIMMED = 12, 2.2, 2.5, 100
BEFORE = (WINDOW + 1) // 2 - 1
AFTER = WINDOW - BEFORE

SEGMENTS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@cache
def _ln_factorials(n: int) -> np.ndarray:
    """ln k! for k up to n, to six decimals, so that ties fall alike everywhere."""
    return np.round([math.lgamma(k + 1) for k in range(n + 1)], 6)


def _counts(text: str, letters: str = STANDARD) -> np.ndarray:
    """Of each standard residue how often it stands before each place."""
    data = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    order = np.frombuffer(letters.encode(), np.uint8)
    return np.concatenate([np.zeros((1, 20), np.int64), np.cumsum(data[:, None] == order, axis=0)])


def entropies(counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The entropy of every window, by the place in its middle; infinite where there is no window."""
    n = len(counts) - 1
    out = np.full(n, np.inf)
    if n >= width:
        own = counts[width:] - counts[:-width]
        total = own.sum(1)
        spread = (own * np.log2(np.maximum(own, 1))).sum(1)
        safe = np.maximum(total, 1)
        middle = (width + 1) // 2 - 1
        out[middle : middle + len(own)] = np.where(total > 0, np.log2(safe) - spread / safe, 0.0)
    return out


def _least_likely(counts: np.ndarray) -> tuple[int, int]:
    """First and last place of the part of a stretch whose composition is the least likely by chance; of
    equals the longest, then the first."""
    n = len(counts) - 1
    ln = _ln_factorials(max(n, 20))
    best, found = 1.0, (0, n - 1)
    for width in range(n, max(1, n - MOST_TRIMMED), -1):
        own = counts[width:] - counts[:-width]
        ways = ln[width] - ln[own].sum(1)
        kinds = ln[20] - sum(ln[(own == k).sum(1)] for k in range(int(own.max()) + 1))
        p = kinds + ways - width * math.log(20)
        at = int(p.argmin())
        if p[at] < best:
            best, found = p[at], (at, at + width - 1)
    return found


def stretches(counts: np.ndarray, offset: int = 0) -> Iterator[tuple[int, int]]:
    """First and last places of low-complexity stretches, from left to right."""
    h = entropies(counts)
    triggers = np.flatnonzero(h <= TRIGGER)
    breaks = np.flatnonzero(h > BOUND)
    free = BEFORE
    for i in triggers:
        if i < free:
            continue
        low = max(free, int(breaks[np.searchsorted(breaks, i) - 1]) + 1)
        k = np.searchsorted(breaks, i)
        high = int(breaks[k]) - 1 if k < len(breaks) else len(h) - 1
        begin, end = low - BEFORE, high + AFTER - 1
        first, last = _least_likely(counts[begin : end + 2])
        first, last = begin + first, begin + last
        if i + AFTER - 1 < first:
            yield from stretches(counts[begin : first + 1], offset + begin)
        yield offset + first, offset + last
        free = min(high, last + BEFORE) + 1


def low_complexity(residues: str | None) -> list[tuple[int, int]]:
    """The stretches of upper-case residues that are masked; where two overlap, the later end counts."""
    out: list[tuple[int, int]] = []
    for first, last in stretches(_counts(residues or "")):
        if out and out[-1][1] >= first:
            out[-1] = out[-1][0], last
        else:
            out.append((first, last))
    return out


def mask(residues: str | None) -> str | None:
    if not residues:
        return residues
    for first, last in low_complexity(residues):
        residues = residues[:first] + "X" * (last - first + 1) + residues[last + 1 :]
    return residues


@F.pandas_udf(T.StringType())
def _mask(texts: pd.Series) -> pd.Series:
    return texts.map(mask, na_action="ignore")


@F.pandas_udf(SEGMENTS)
def _segments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"begin": a, "end": b} for a, b in low_complexity(t)])


def mask_residues(c: Column) -> Column:
    """Cleaned residues with their low-complexity stretches made X. Nulls stay null; texts shorter than
    the window are never masked."""
    return _mask(c)


def entropy_windows(df: DataFrame, idx: str, residues: str, letters: str = STANDARD_INTERNAL, width: int = WINDOW) -> DataFrame:
    """(`idx`, `start`, `entropy`) of every window of `width` residues of each record, in bits over the
    standard residues, whose letters are given. Running counts give each window in a few operations, where
    counting letters by string functions takes sixty. Null and shorter residues have no windows."""
    rows = spread(df.select(idx, residues).where(F.char_length(residues) >= width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, values, held = [], [], [], 0
            for k, text in enumerate(b.column(1).to_pylist()):
                own = entropies(_counts(text, letters), width)
                own = own[np.isfinite(own)]
                ids.append(np.full(len(own), k))
                starts.append(np.arange(len(own), dtype=np.int32))
                values.append(own)
                held += len(own)
                if held > 200_000:
                    yield _windows(b, ids, starts, values)
                    ids, starts, values, held = [], [], [], 0
            if ids:
                yield _windows(b, ids, starts, values)

    schema = T.StructType([rows.schema[idx], T.StructField("start", T.IntegerType()), T.StructField("entropy", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def _windows(b: pa.RecordBatch, ids: list, starts: list, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(starts)), pa.array(np.concatenate(values))], [b.schema.names[0], "start", "entropy"])


def segments(df: DataFrame, idx: str, residues: str) -> DataFrame:
    """(`idx`, `begin`, `end`): the masked stretches of each record, 0-based, both ends included."""
    rows = df.where(F.col(residues).isNotNull()).select(idx, F.explode(_segments(F.col(residues))).alias("s"))
    return rows.select(idx, "s.begin", "s.end")
