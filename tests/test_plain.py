"""Queries that SQL cannot carry, against plain versions over all tables of the smallest scale."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import duckdb
import pytest
from oracle import SMALL
from test_search import TABLE, plain_hsp, plain_trace

from strandlake.functions import alphabet as A
from strandlake.options import SearchOptions
from strandlake.plans import catalog

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
SCORES = {a + b: int(TABLE[ord(a) - 65, ord(b) - 65]) for a in A.INTERNAL for b in A.INTERNAL}


def table(name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def residues():
    return dict(table("queries", "query_idx, residues")), dict(table("proteins", "protein_idx, residues"))


def plain_alignment(q: str, t: str) -> tuple[int, int, int]:
    """Column by column, a gap of k residues costing 11 + (k - 1)."""
    best, q_end, t_end = 0, -1, -1
    h, e = [0] * len(q), [-(10**9)] * len(q)
    for j, b in enumerate(t):
        f, diagonal = -(10**9), 0
        for i, a in enumerate(q):
            up = h[i]
            gap = max(e[i] - 1, up - 11)
            cell = max(0, diagonal + SCORES[a + b], gap, f)
            e[i], h[i], diagonal = gap, cell, up
            f = max(f - 1, cell - 11)
            if cell > best:
                best, q_end, t_end = cell, i, j
    return best, q_end, t_end


@pytest.fixture(scope="module")
def walked(residues):
    """The seeds of each pair of a query and a protein."""
    queries, proteins = residues
    order = sorted((p[s : s + 128], k, s) for k, p in proteins.items() for s in range(len(p or "")))
    keys = [x[0] for x in order]
    found = defaultdict(list)
    for n, q in queries.items():
        for i in range(len(q or "") - 5):
            if q[i] == A.UNKNOWN_INTERNAL:
                continue
            at = bisect_left(keys, q[i : i + 128])
            for step, pos in ((1, at), (-1, at - 1)):
                while 0 <= pos < len(order):
                    _, k, s = order[pos]
                    score, length = plain_hsp(q, i, proteins[k], s)
                    if length < 5:
                        break
                    found[n, k].append((score, length, -i))
                    pos += step
    return found


def test_found_seeds(spark, walked):
    want = {(*pair, *max(own)[:2], len(own), -max(own)[2], int(len({x[2] for x in own}) > 1)) for pair, own in walked.items()}
    got = catalog.QUERIES["found_seeds"](spark, str(SMALL)).select("query_idx", "protein_idx", "gapless_score", "gapless_length", "suffix_counter", "suffix_offset", "suffix_multiple")
    assert {tuple(r) for r in got.collect()} == want and want


def test_aligned_scores(spark, residues):
    queries, proteins = residues
    pairs = {(q, p) for q, p, ok in table("hits", "query_idx, db_index, is_aligned AND gapless_score >= 40 AND qend >= 0 AND send >= 0") if ok}
    want = {(q, p, *plain_alignment(queries[q], proteins[p])) for q, p in pairs if q in queries and p in proteins}
    got = catalog.QUERIES["aligned_scores"](spark, str(SMALL))
    assert {tuple(r) for r in got.collect()} == want and want


@pytest.fixture(scope="module")
def reported(residues, walked):
    """(query, protein, E-value, bit score) of the hits of a search."""
    queries, proteins = residues
    o, n, p = SearchOptions(), sum(len(r or "") for r in proteins.values()), len(proteins)
    lists = defaultdict(list)
    for (q, k), own in walked.items():
        if (gapless := max(own)[0]) >= 40:
            score = plain_alignment(queries[q], proteins[k])[0]
            cut = math.log(o.kappa * len(queries[q]) * n) / o.entropy
            nats = o.lambda_ * score - math.log(o.kappa)
            e = max(len(queries[q]) - cut, 1) * max(n - cut * p, 1) * math.exp(-nats)
            lists[q].append((-nats / math.log(2), -gapless, k, e if e > 1e-180 else 0.0))
    return [(q, k, f"{e:.3e}", int(-bits)) for q, own in lists.items() for bits, _, k, e in sorted(own)[: o.hits] if e <= o.evalue]


@pytest.fixture(scope="module")
def names():
    return dict(table("queries", "query_idx, query_id")), dict(table("proteins", "protein_idx, seq_id"))


def test_search_fast(spark, names, reported):
    want = [(names[0][q], names[1][k], *rest) for q, k, *rest in reported]
    got = [tuple(r) for r in catalog.QUERIES["search_fast"](spark, str(SMALL)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


def test_search_tabular(spark, residues, names, reported):
    """All columns; a path whose ties lie beyond the band may differ, which few do."""
    queries, proteins = residues
    want = []
    for q, k, e, bits in reported:
        _, q_end, t_end = plain_alignment(queries[q], proteins[k])
        _, back_q, back_t = plain_alignment(queries[q][q_end::-1], proteins[k][t_end::-1])
        first_q, first_t = q_end - back_q, t_end - back_t
        length, opened, mismatched, same = plain_trace(queries[q][first_q : q_end + 1], proteins[k][first_t : t_end + 1], 11, 1)
        want.append((names[0][q], names[1][k], f"{same / length * 100:.2f}", length, mismatched, opened, first_q + 1, q_end + 1, first_t + 1, t_end + 1, e, bits))
    got = [tuple(r) for r in catalog.QUERIES["search_tabular"](spark, str(SMALL)).collect()]
    ends = [0, 1, 6, 7, 8, 9, 10, 11]
    assert sorted(([r[c] for c in ends] for r in got), key=repr) == sorted(([r[c] for c in ends] for r in want), key=repr)
    assert len(set(got) - set(want)) <= 0.02 * len(want)


def plain_stretches(text: str, offset: int = 0) -> list[tuple[int, int]]:
    """Low-complexity stretches by counting every window anew."""

    def entropy(window: str) -> float:
        counts = [window.count(x) for x in A.STANDARD]
        total = sum(counts)
        return math.log2(total) - sum(c * math.log2(c) for c in counts if c) / total if total else 0.0

    def likelihood(window: str) -> float:
        counts = [window.count(x) for x in A.STANDARD]
        ln = lambda k: round(math.lgamma(k + 1), 6)
        return ln(20) - sum(ln(counts.count(k)) for k in set(counts)) + ln(len(window)) - sum(map(ln, counts)) - len(window) * math.log(20)

    n = len(text)
    h = {i: entropy(text[i - 5 : i + 7]) for i in range(5, n - 6)}
    out, i, free = [], 5, 5
    while i in h:
        if h[i] > 2.2:
            i += 1
            continue
        low = high = i
        while low - 1 >= free and h[low - 1] <= 2.5:
            low -= 1
        while high + 1 in h and h[high + 1] <= 2.5:
            high += 1
        begin, part = low - 5, text[low - 5 : high + 7]
        best, first, last = 1.0, 0, len(part) - 1
        for width in range(len(part), max(1, len(part) - 100), -1):
            for at in range(len(part) - width + 1):
                if (p := likelihood(part[at : at + width])) < best:
                    best, first, last = p, at, at + width - 1
        first, last = begin + first, begin + last
        if i + 6 < first:
            out += plain_stretches(text[begin:first], offset + begin)
        out.append((offset + first, offset + last))
        i = free = min(high, last + 5) + 1
    return out


def test_masked_stretches(spark, residues):
    want = set()
    for k, text in residues[1].items():
        merged: list[tuple[int, int]] = []
        for first, last in plain_stretches((text or "").translate(str.maketrans(A.INTERNAL, A.SIMILARITY_ORDER))):
            if merged and merged[-1][1] >= first:
                merged[-1] = merged[-1][0], last
            else:
                merged.append((first, last))
        want |= {(k, *x) for x in merged}
    assert {tuple(r) for r in catalog.QUERIES["masked_stretches"](spark, str(SMALL)).collect()} == want and want
