from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import regex

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SMALL, agree, connect

from strandlake.llm import encoding, leakage, ledger, packing, queries, spans, sql, topn, words
from strandlake.llm.components import link_groups
from strandlake.llm.leakage import find_leaks
from strandlake.llm.topn import top_n_per_group

NAN = float("nan")


# The registered queries


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_agrees_with_sql(spark, name):
    agree(queries.QUERIES[name](spark, str(SMALL)), connect(SMALL), sql.SQL[name])


def test_entry_adds_the_queries():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(sql.SQL) <= set(queries.QUERIES)


# Top N


def best(rows: list[tuple], n: int) -> list[tuple]:
    out = []
    for g in {r[0] for r in rows}:
        own: dict = {}
        for _, score, item in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
            own.setdefault(item, score)
        out += [(g, k, item, score) for k, (item, score) in enumerate(own.items(), 1) if k <= n]
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_top_n(spark, batch):
    random.seed(batch)
    rows = [(random.choice([None, "a", "a", "a", "b", "c"]), random.choice([None, 1, 2, 3, 4, 5]), random.choice([None, *range(30)])) for _ in range(400)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "g string, score int, item long, rank_no string, _rank int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = top_n_per_group(df, ["g"], [("score", False)], "item", 3)
        assert got.columns == ["g", "rank_no", "item", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == best(rows, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_n_of_odd_groups(spark):
    df = spark.createDataFrame([(NAN, 1.0, "x"), (NAN, 2.0, "y"), (0.5, NAN, "z"), (0.5, NAN, "z")], "g double, s double, i string")
    got = top_n_per_group(df, ["g"], [("s", True)], "i", 1).collect()
    assert [(r.rank_no, r.i) for r in sorted(got, key=repr)] == [(1, "z"), (1, "x")]
    assert top_n_per_group(df.limit(0), ["g"], [("s", True)], "i", 1).collect() == []
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], [("s", True)], "g", 1)


def test_hot_group_leaves_few_rows_in_each_partition(spark):
    df = spark.range(40_000).selectExpr("0 AS g", "id % 977 AS s", "id AS i").repartition(8)
    plan = top_n_per_group(df, ["g"], [("s", False)], "i", 10)
    assert [r.i for r in plan.orderBy("rank_no").collect()] == sorted(range(976, 40_000, 977))[:10]
    assert topn._first_n is not None and plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


# Link groups


def plain_groups(edges: list[tuple]) -> dict:
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "path", "star", "odd"])
def test_link_groups(spark, kind):
    random.seed(1)
    edges = {
        "random": [(random.randrange(300), random.randrange(300)) for _ in range(180)],
        "path": [(k, k + 1) for k in range(60)],
        "star": [(500, k) for k in range(300)] + [(k, 500) for k in range(10)],
        "odd": [(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4), (6, 5)],
    }[kind]
    df = spark.createDataFrame([(*e, "clash") for e in edges], "a long, b long, v string")
    assert {r.member: r.root for r in link_groups(df, "a", "b").collect()} == plain_groups(edges)


def test_link_groups_of_nothing(spark):
    df = spark.createDataFrame([], "a long, b long")
    got = link_groups(df, "a", "b")
    assert got.columns == ["member", "root"] and got.collect() == []


def test_hot_vertices_take_the_broadcast(spark, monkeypatch):
    from strandlake import session
    from strandlake.llm import components

    for module in (session, components):
        monkeypatch.setattr(module, "HOT_MIN_ROWS", 10)
        monkeypatch.setattr(module, "HOT_SHARE", 3)
    edges = [(0, k) for k in range(1, 40)] + [(50, 51), (51, 52)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.member: r.root for r in link_groups(df, "a", "b").collect()} == plain_groups(edges)


# Ledger of copies

RECORDS = [
    (5, "tr|0A|x", "ACDE", 3.0),
    (2, "X/0a/TR", "ac de\n", 1.0),
    (9, "tr.tr.0A.x", "ACDE", 1.0),
    (7, "TR,0A,X", "A-C.D*E", None),
    (1, None, "ACDE", 1.0),
    (3, "tr|0A|x", None, 1.0),
    (4, "||", "ACDE", 1.0),
    (6, "tr|0A|x", "1 2", 1.0),
    (None, "tr|0A|x", "ACDE", 1.0),
    (8, "tr|0A|x", "ACDF", 2.0),
    (8, "tr|0A|x", "ACDF", 2.0),
    (10, "tréA", "Kß", 2.0),
    (11, "TR a", "k", 2.0),
    (12, "long", "A" * 200_000, 2.0),
    (13, "LONG", "a " * 200_000, 2.0),
]


def test_ledger(spark, tmp_path):
    df = spark.createDataFrame([(*r, b"k", 1) for r in RECORDS], "i long, n string, r string, at double, key binary, bucket int")
    counted = ledger.fold_batches(df, str(tmp_path / "l"), "i", "n", "r", "at", batches=3, buckets=4)
    assert {(r.first_idx, r.copies) for r in counted.collect()} == {(2, 3), (9, 1), (8, 2), (10, 2), (12, 2)}
    pairs = ledger.hidden_copies(df, counted, "i", "n", "r", 4)
    assert {tuple(r) for r in pairs.collect()} == {(2, 5), (2, 7), (10, 11), (12, 13)}


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "l")
    df = spark.createDataFrame([(5, "a", "x"), (6, "a", "X")], "i long, n string, r string")
    more = spark.createDataFrame([(3, "A", "x")], "i long, n string, r string")
    for part, number in ((df, 0), (more, 1), (more, 1)):
        ledger.add_batch(spark, path, ledger.canonical(part, "i", "n", "r", 4), number)
    assert [(r.first_idx, r.copies) for r in ledger.read_ledger(spark, path).collect()] == [(3, 3)]
    ledger.add_batch(spark, path, ledger.canonical(df, "i", "n", "r", 4), 0)
    ledger.vacuum(spark, path)
    assert [(r.first_idx, r.copies) for r in ledger.read_ledger(spark, path).collect()] == [(3, 3)]


def test_a_lost_batch_leaves_the_ledger_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "l")
    keys = ledger.canonical(spark.createDataFrame([(5, "a", "x"), (6, "b", "y")], "i long, n string, r string"), "i", "n", "r", 4)
    ledger.add_batch(spark, path, keys, 0)
    with monkeypatch.context() as m:
        m.setattr(ledger, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.add_batch(spark, path, keys, 1)
    assert {(r.first_idx, r.copies) for r in ledger.read_ledger(spark, path).collect()} == {(5, 1), (6, 1)}
    ledger.add_batch(spark, path, keys, 1)
    assert {(r.first_idx, r.copies) for r in ledger.read_ledger(spark, path).collect()} == {(5, 2), (6, 2)}


def test_hot_keys_of_the_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "HOT_SHARE", 3)
    df = spark.range(60).selectExpr("id AS i", "IF(id < 40, 'hot', concat('n', id DIV 2)) AS n", "'ACD' AS r", "timestamp_seconds(id) AS at")
    counted = ledger.fold_batches(df, str(tmp_path / "l"), "i", "n", "r", "at")
    pairs = {tuple(r) for r in ledger.hidden_copies(df, counted, "i", "n", "r", 4).collect()}
    assert pairs == {(0, k) for k in range(1, 40)} | {(k, k + 1) for k in range(40, 60, 2)}


def test_ledger_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "i long, n string, r string, at timestamp")
    assert ledger.fold_batches(df, str(tmp_path / "l"), "i", "n", "r", "at").collect() == []


# Shared spans


def plain_shared(records: list[tuple], length: int) -> dict:
    where: dict = {}
    for i, t in records:
        for k in range(len(t or "") - length + 1):
            where.setdefault(t[k : k + length], set()).add(i)
    out = {}
    for i, t in records:
        covered = {k + j for k in range(len(t or "") - length + 1) if len(where[t[k : k + length]]) > 1 for j in range(length)}
        if covered and i is not None:
            out[i] = len(covered)
    return out


@pytest.mark.parametrize("length", [5, 8, 32])
def test_shared_lengths(spark, length):
    random.seed(length)
    records = []
    for i in range(40):
        t = "".join(random.choices("ABCDEFGH", k=random.randint(0, 90)))
        if records and random.random() < 0.7:
            other = random.choice(records)[1]
            low = random.randint(0, len(other))
            t = t[:20] + other[low : low + random.randint(0, 60)] + t[20:]
        records.append((i, t))
    records += [(50, "Q" * 80), (51, "Q" * 70 + "R"), (52, "XY" * 40), (53, "ü" * 40), (54, "é" + "ü" * 40), (55, "")]
    df = spark.createDataFrame([(*r, 7, "x") for r in records] + [(60, None, 7, "x"), (None, "Q" * 80, 7, "x")], "i long, t string, hash int, id string")
    got = {r.protein_idx: r.shared_len for r in spans.shared_lengths(df, "i", "t", length).collect()}
    assert got == plain_shared(records, length)


def test_repeat_within_one_record_or_id_is_not_shared(spark):
    block = "ABCDEFGHIJKLMNOPQRSTUVWXYABCDEFGHIJKL"
    df = spark.createDataFrame([(1, block + "Z" + block), (1, block)], "i long, t string")
    assert spans.shared_lengths(df, "i", "t").collect() == []
    assert spans.shared_lengths(df.limit(0), "i", "t").collect() == []


def test_long_texts_share(spark):
    random.seed(2)
    a = "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXY", k=300_000))
    df = spark.createDataFrame([(1, a), (2, "ZZ" + a[1000:260_000])], "i long, t string")
    assert {tuple(r) for r in spans.shared_lengths(df, "i", "t").collect()} == {(1, 259_000), (2, 259_000)}


def test_rolling_hash_tells_windows_apart():
    random.seed(1)
    text = "".join(random.choices("AB", k=3000))
    for k in (1, 2, 3, 5, 8, 13, 16, 17):
        h = spans.rolling(spans._letters(text), k)
        own = {}
        assert all(own.setdefault(text[i : i + k], h[i]) == h[i] for i in range(len(text) - k + 1))
        assert len(set(own.values())) == len(own)


# Packing


@pytest.fixture(scope="module")
def counts():
    if not Path(packing.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    return packing.token_counts(packing.VOCABULARY)


def test_token_counts_are_exact(counts):
    random.seed(6)
    parts = ["The", "über", "1234", "…", "’s", " ", "  ", "\n", "\t", " ", "x" * 70, "don't", "привет", ",", "\r\n", "é", " ", ""]
    for _ in range(3000):
        text = random.choice(["", " "]).join(random.choices(parts, k=random.randint(0, 12)))
        assert counts.count(text) == len(counts.encode(text)), repr(text)
    assert counts.count(None) == 0


def check_packing(rows, sizes: dict, kinds: dict) -> None:
    fill: Counter = Counter()
    pieces: dict = {}
    for r in rows:
        if r.container_id is None:
            assert r.n_tokens == 0
        else:
            fill[r.container_kind, r.container_id] += r.n_tokens
        pieces.setdefault((r.container_kind, r.i), []).append((r.piece_no, r.token_start, r.n_tokens))
    assert all(n <= kinds[k] for (k, _), n in fill.items())
    assert set(pieces) == {(k, i) for k in kinds for i in sizes}
    for (k, i), own in pieces.items():
        own.sort()
        assert [p[0] for p in own] == list(range(len(own)))
        assert sum(p[2] for p in own) == sizes[i]
        assert len(own) == 1 or sizes[i] > kinds[k]
        assert all(b[1] == a[1] + a[2] and a[2] == kinds[k] for a, b in zip(own, own[1:], strict=False))


def test_packing(spark, counts):
    random.seed(9)
    texts = [" ".join(random.choices(["word", "Fluss", "über", "12"], k=random.choice([1, 5, 20, 60, 200]))) for _ in range(600)] + ["", None, "a " * 5000, "  "]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "i long, t string, capacity int, kind string").repartition(7)
    kinds = {"s": 64, "m": 256}
    containers = spark.createDataFrame([("s", 64), ("m", 256), ("m", 256), ("none", None), ("zero", 0)], "container_kind string, capacity int")
    for open_bins, fan_in in ((8, 64), (2, 2)):
        rows = packing.pack_texts(docs, containers, "i", "t", open_bins=open_bins, fan_in=fan_in).collect()
        sizes = {i: counts.count(t) for i, t in enumerate(texts)}
        check_packing(rows, sizes, kinds)
        for k, capacity in kinds.items():
            used = len({r.container_id for r in rows if r.container_kind == k and r.container_id is not None})
            assert used <= 1.1 * sum(sizes.values()) / capacity + 2


def test_packing_of_nothing(spark, counts):
    docs = spark.createDataFrame([], "i long, t string")
    kinds = spark.createDataFrame([("s", 64)], "container_kind string, capacity int")
    assert packing.pack_texts(docs, kinds, "i", "t").collect() == []
    assert packing.pack_texts(spark.createDataFrame([(1, "a")], "i long, t string"), kinds.limit(0), "i", "t").collect() == []


# Leakage


def plain_words(text: str | None) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def plain_distance(pattern: list[str], text: list[str]) -> int:
    row = [0] * (len(text) + 1)
    for k, w in enumerate(pattern, 1):
        new = [k]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def plain_leaks(docs: list[tuple], items: list[tuple], window: int, budget: int) -> set:
    out = set()
    for d, text in docs:
        for i, item in items:
            w, t = plain_words(item), plain_words(text)
            found = [plain_distance(w[k : k + window], t) for k in range(len(w) - window + 1)] if t else []
            if found and min(found) <= budget and d is not None and i is not None:
                out.add((d, i, min(found)))
    return out


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_leaks_against_plain_distance(spark, monkeypatch, budget):
    random.seed(budget)
    monkeypatch.setattr(words, "BLOCK", 400)
    monkeypatch.setattr(leakage, "AT_ONCE", 50)
    vocabulary = ["eins", "Zwei", "trois", "ÉTÉ", "п2", "six", "sept", "ſ", "İx"]
    items = [(k, " ".join(random.choices(vocabulary, k=random.randint(5, 20)))) for k in range(12)]
    docs = []
    for k in range(60):
        w = random.choices(vocabulary, k=random.randint(0, 30))
        if k % 2:
            own = random.choice(items)[1].split()
            for _ in range(random.randint(0, 3)):
                at = random.randrange(len(own))
                own[at : at + random.randint(0, 1)] = random.choices(vocabulary, k=random.randint(0, 1))
            w[5:5] = own
        docs.append((k, random.choice([" ", ", ", "\n"]).join(w).swapcase()))
    docs += [(None, docs[1][1]), (70, None), (71, ""), (1, docs[1][1]), (72, "x" * 5000 + " " + docs[3][1])]
    d = spark.createDataFrame([(*r, 0, "c") for r in docs], "doc_id long, text string, item int, distance string")
    i = spark.createDataFrame([*items, (None, items[0][1]), (90, None), (91, ""), items[0]], "item_id long, text string")
    got = find_leaks(d, i, "doc_id", "text", "item_id", "text", window=8, budget=budget)
    assert {tuple(r) for r in got.collect()} == plain_leaks(docs, items, 8, budget)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    monkeypatch.setattr(leakage, "ITEM_CHARS", 40)
    assert {tuple(r) for r in find_leaks(d, i, "doc_id", "text", "item_id", "text", window=8, budget=budget).collect()} == plain_leaks(docs, items, 8, budget)
    assert find_leaks(d.limit(0), i, "doc_id", "text", "item_id", "text").collect() == []
    assert find_leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").collect() == []


def test_word_hashes_are_the_words(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 50)
    texts = ["Ein Wort, zwei_drei  4½ x²", None, "", "ΑΣ ΑΣ", "long " * 40, "y" * 300, "éa"]
    own: dict = {}
    got = [(int(t), int(h)) for hashes, of in words.word_hashes(texts) for h, t in zip(hashes, of, strict=True)]
    want = [(k, w) for k, t in enumerate(texts) for w in plain_words(t)]
    assert [t for t, _ in got] == [t for t, _ in want]
    assert all(own.setdefault(w, h) == h for (_, h), (_, w) in zip(got, want, strict=True)) and len(set(own.values())) == len(own)


# Wrong encodings

SENTENCES = {
    "de": "Der zuständige Prüfer überprüft die Gebühren für größere Häuser und schützt die Dörfer während der Übergänge in Österreich",
    "fr": "La majorité des députés répète que l’été dernier a été négligé à la troisième année après la tempête où le péage coûtait déjà",
    "pl": "Rząd odłożył naprawę żeglugi według największą ostrożnością i przyjął opłatę miejscowości również łódź wyjaśnić źle",
    "bg": "Правителството не обясни втория доклад за канала и защити моста без закон през зимата на града",
    "en": "The ministry’s own adviser said “harbour clause” – and nothing else about the café or the naïve plan of the façade",
}


def sample(seed: int, n: int) -> list[str]:
    random.seed(seed)
    return [" ".join(random.choices(SENTENCES[lang].split(), k=30)) for lang in random.choices(list(SENTENCES), k=n)]


@pytest.fixture(scope="module")
def model():
    return encoding.Model(sample(1, 800))


@pytest.mark.parametrize("chain", [c for c in encoding.CHAINS if c[0][0] == "utf-8"][:10])
def test_utf8_chains_are_found_and_undone(model, chain):
    texts = [t for t in sample(2, 60) if not t.isascii() and (g := encoding.garble(t, chain)) and g != t]
    garbled = [encoding.garble(t, chain) for t in texts]
    found = {t: text for t, _, _, text in model.repair(garbled)}
    assert len(found) >= 0.97 * len(texts)
    assert sum(found.get(k) == t for k, t in enumerate(texts)) >= 0.9 * len(texts)


def test_single_byte_chains_are_found(model):
    for chain in ((("cp1252", "mac_roman"),), (("cp1250", "mac_roman"),), (("cp1252", "cp1251"),)):
        texts = [t for t in sample(3, 80) if not t.isascii() and any(w in t for w in ("für", "négligé", "größere", "odłożył", "naprawę")) and encoding.garble(t, chain)]
        found = list(model.repair([encoding.garble(t, chain) for t in texts]))
        assert texts and len(found) >= 0.9 * len(texts)


@pytest.mark.parametrize("chain", [c for c in encoding.CHAINS if c[0][0] != "utf-8"])
def test_single_byte_chains_are_undone(model, chain):
    texts = [t for t in sample(12, 60) if not t.isascii() and (g := encoding.garble(t, chain)) and g != t]
    found = {t: text for t, _, _, text in model.repair([encoding.garble(t, chain) for t in texts])}
    assert len(found) >= 0.6 * len(texts)
    assert sum(text == texts[k] for k, text in found.items()) >= 0.8 * len(found)


def test_sound_texts_stay(model):
    odd = ["λόγος ½ £5 ± 3 µg │ ¶ (§ 4)", "Æbel–Øst «Ðarvik» Ångdal „ÂNCORA“", "GEBÜHREN FÜR GRÖSSERE HÄUSER", "La majorité des députés", "ПРАВИТЕЛСТВОТО НЕ ОБЯСНИ", "", "plain"]
    assert list(model.repair(sample(4, 300) + odd)) == []


def test_lost_characters_and_partly_garbled_texts(model):
    lost, part = "Die Geb�hren", "Der Prüfer sagt: " + encoding.garble("Gebühren für Häuser", (("utf-8", "cp1252"),))
    rows = {t: (chain, n, text) for t, chain, n, text in model.repair(["sound", lost, part])}
    assert rows[1] == ("lost", 1, None)
    assert rows[2][1:] == (3, "Der Prüfer sagt: Gebühren für Häuser")


def test_chains_can_be_undone_strictly():
    for chain in encoding.CHAINS:
        for t in sample(5, 20):
            if (g := encoding.garble(t, chain)) is not None:
                assert encoding.restore(g, chain) == t


def test_garbled_texts(spark):
    texts = sample(6, 300)
    texts[10] = encoding.garble(texts[10], (("utf-8", "latin-1"),)) + "\nfür"
    texts[20] = encoding.garble("für größere " * 40_000, (("utf-8", "latin-1"),))
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)] + [(900, None, "x", "y"), (901, "", "x", "y"), (None, texts[20], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chain string, id string")
    got = {r.doc_id: r for r in encoding.garbled_texts(df, "doc_id", "text").collect()}
    assert set(got) == {10, 20, None} and got[10].restored.endswith("\nfür") and got[20].restored == "für größere " * 40_000
    assert encoding.garbled_texts(df.limit(0), "doc_id", "text").collect() == []


def test_words_outside_the_sample_decide_single_byte_chains(spark, model):
    """A name and a two-letter word that the sample does not hold or count, each garbled in one text."""
    chain = (("cp1252", "mac_roman"),)
    name, short = "Krümmelbäcker", "où"
    assert not {encoding.core(name), encoding.core(short)} & model.known
    texts = [f"Es spricht {name} für Häuser", f"Danach {name} selbst", *[f"Wieder {short} Nummer {k}" for k in range(30)], "½ « ± § µ", "‡ und º"]
    texts += [f"Es spricht {encoding.garble(name, chain)} hier", f"Wieder {encoding.garble(short, chain)} hier"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert list(model.repair(texts)) == []
    got = {r.doc_id: r.restored for r in encoding.garbled_texts(df, "doc_id", "text", model).collect()}
    assert got == {34: f"Es spricht {name} hier", 35: f"Wieder {short} hier"}


def test_every_likely_chain_is_tried_on_a_word(model):
    """The chain that made the word is the least likely of ten that pass their thresholds."""
    chain = (("cp1252", "mac_roman"),)
    own, word = encoding.CHAINS.index(chain) + 1, encoding.garble("négligé", chain)
    margin = np.full(len(encoding.NAMES), -1.0)
    margin[1:10], margin[own], margin[-1] = 50, 40, 60
    assert (own, "négligé") in model._undo(word, margin)


def test_a_text_takes_the_chain_that_most_of_its_words_name():
    mac, koi = encoding.CHAINS.index((("cp1252", "mac_roman"),)) + 1, encoding.CHAINS.index((("cp1251", "mac_roman"),)) + 1
    words = {"‡": [(koi, "а", True), (mac, "à", True)], "rÈgion": [(mac, "région", True)], "pÈage": [(koi, "pйage", False), (mac, "péage", False)]}
    assert {w: r for w, (_, r, _) in encoding.decide(words).items()} == {"‡": "à", "rÈgion": "région", "pÈage": "péage"}


def test_scores_do_not_depend_on_the_batch(model):
    own = encoding.Words([t for t in sample(7, 50)])
    one = np.concatenate([encoding.Words([t]).scores(model.table) for t in sample(7, 50) if not t.isascii()])
    assert np.allclose(own.scores(model.table), one, atol=1e-3)
