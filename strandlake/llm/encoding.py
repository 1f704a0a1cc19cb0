"""Text read with a wrong encoding: a classifier names the chain of encodings, which is then inverted."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import cut_lineage, spread

#: Texts the classifier is fitted on, at most, and characters of each that it learns from.
SAMPLE_TEXTS, SAMPLE_CHARS = 4_000, 10_000
#: Hash buckets of byte bigrams.
BUCKETS = 1 << 16
#: Smoothing of bigram counts.
ALPHA = 0.05
#: Log-likelihood by which a garbled class must beat sound text on a word: where the inverse is strict
#: UTF-8, and where it is a single-byte encoding, which decodes almost anything.
MARGIN_UTF8, MARGIN_BYTE = 2.0, 8.0
#: Texts of a batch that are handled at once, in characters.
BLOCK = 2_000_000
#: Where a restored word has up to SHORT letters, which many chains can give by chance, texts that hold it for
#: each that holds the word as it stands.
SHORT, SHORT_TIMES = 2, 20
#: Times that a restored word is looked at again.
MOST_STEPS = 3
#: Estimates of how many words of a text are garbled, at most.
ROUNDS = 10
#: Different words a task counts before it passes the counts on.
COUNTED = 200_000

LOST = "\ufffd"
WORD = re.compile(r"[^\x00-\x20]+")

# Chains of (written, read) encodings that the classifier tells apart.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    (("utf-8", "latin-1"),),
    (("utf-8", "cp1252"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "iso8859-2"),),
    (("utf-8", "mac_roman"),),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "cp852"),),
    (("utf-8", "cp866"),),
    (("utf-8", "koi8-r"),),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "cp1252"), ("utf-8", "latin-1")),
    (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "cp1251"), ("utf-8", "cp1251")),
    (("utf-8", "cp1250"), ("utf-8", "cp1250")),
    (("cp1252", "cp1250"),),
    (("cp1252", "cp1251"),),
    (("cp1252", "mac_roman"),),
    (("cp1252", "cp437"),),
    (("cp1252", "cp850"),),
    (("cp1250", "cp1252"),),
    (("cp1250", "cp1251"),),
    (("cp1250", "mac_roman"),),
    (("cp1250", "cp437"),),
    (("cp1250", "cp852"),),
    (("iso8859-2", "cp1252"),),
    (("iso8859-2", "cp1250"),),
    (("cp1251", "cp1252"),),
    (("cp1251", "cp1250"),),
    (("cp1251", "mac_roman"),),
    (("cp1251", "cp437"),),
    (("cp1251", "cp866"),),
    (("cp1251", "koi8-r"),),
    (("mac_roman", "cp1252"),),
    (("cp437", "cp1252"),),
    (("cp850", "cp1252"),),
    (("cp852", "cp1250"),),
    (("cp866", "cp1251"),),
    (("cp866", "cp1252"),),
    (("koi8-r", "cp1251"),),
    (("koi8-r", "cp1252"),),
]
#: Class 0 is sound text, the last one lost characters.
NAMES = ["sound", *("+".join(f"{w}>{r}" for w, r in chain) for chain in CHAINS), "lost"]
IS_UTF8 = np.array([False, *(chain[0][0] == "utf-8" for chain in CHAINS), False])


@cache
def _tables(name: str) -> tuple[str, dict[str, int]]:
    """The 256 characters of a single-byte encoding; bytes it leaves open stand for the control
    characters of the same number, as readers on the web take them."""
    chars = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


def _decode(data: bytes, name: str) -> str:
    return data.decode("utf-8") if name == "utf-8" else data.decode("latin-1").translate(_tables(name)[0])


def _encode(text: str, name: str) -> bytes:
    if name == "utf-8":
        return text.encode("utf-8")
    table = _tables(name)[1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        raise UnicodeError(name) from None


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """`text` written and read by the steps of `chain`; None where an encoding lacks a character."""
    try:
        for written, read in chain:
            text = _decode(_encode(text, written), read)
    except UnicodeError:
        return None
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text from which `chain` made `text`; None unless each step can be undone strictly."""
    try:
        for written, read in reversed(chain):
            text = _decode(_encode(text, read), written)
    except UnicodeError:
        return None
    return text


def bigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams with a byte beyond ASCII, and their places."""
    high = data >= 0x80
    at = np.flatnonzero(high[:-1] | high[1:])
    code = data[at].astype(np.uint32) * np.uint32(40503) + data[at + 1].astype(np.uint32) * np.uint32(2531011)
    return ((code ^ (code >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64), at


class Words:
    """The words, cut at ASCII white space, of some texts that hold a character beyond ASCII."""

    def __init__(self, texts: list[str]) -> None:
        self.blob = (" " + " \n ".join(texts) + " ").encode("utf-8", "surrogatepass")
        data = np.frombuffer(self.blob, np.uint8)
        code, at = bigrams(data)
        gap = np.flatnonzero(data <= 32)
        word = np.searchsorted(gap, at, "right")  # a bigram that begins with a space belongs to the word after it
        self.code = code
        first = np.flatnonzero(np.diff(word, prepend=-1)) if len(word) else np.zeros(0, np.int64)
        self.first = first
        self.low, self.high = gap[word[first] - 1] + 1, gap[np.minimum(word[first], len(gap) - 1)]
        ends = np.flatnonzero(data == 10)
        self.text_of = np.searchsorted(ends, self.low)

    def __len__(self) -> int:
        return len(self.first)

    def word(self, k: int) -> str:
        return self.blob[self.low[k] : self.high[k]].decode("utf-8", "surrogatepass")

    def scores(self, table: np.ndarray) -> np.ndarray:
        """The log-likelihood of each word under each class."""
        out = np.empty((len(self), table.shape[1]), np.float32)
        for low in range(0, len(self), 20_000):
            high = min(low + 20_000, len(self))
            begin, end = self.first[low], self.first[high] if high < len(self) else len(self.code)
            out[low:high] = np.add.reduceat(table[self.code[begin:end]], self.first[low:high] - begin, axis=0)
        return out


def _flat(texts: list[str | None]) -> list[str]:
    """Texts with line ends made spaces, so that one marks the end of a text."""
    return [(t or "").replace("\n", " ") for t in texts]


def core(word: str) -> str:
    """The word without what stands before its first and after its last letter or digit, in lower case."""
    low, high = 0, len(word)
    while low < high and not word[low].isalnum():
        low += 1
    while high > low and not word[high - 1].isalnum():
        high -= 1
    return word[low:high].lower()


def counted(word: str) -> str:
    """What a word is counted as: its core, or the whole of it where that is empty."""
    return core(word) or word


def evidence(word: str, restored: str | None) -> str | None:
    """The key whose count tells whether `word` was `restored`. None where there is no letter to go by: a symbol
    that gives another symbol, or a single letter, is more often rare than garbled."""
    key = core(restored or "")
    return None if not key or (len(key) == 1 and not any(map(str.isalpha, word))) else key


#: The chains that can have made a word, likeliest first, each with the word it undoes to.
Made = list[tuple[int, str | None]]
#: A word's class, 0 for sound, the word restored where that can be, and whether it is sure.
Finding = tuple[int, str | None, bool]


def choose(made: Made, known: Callable[[str], bool]) -> Finding:
    """The likeliest chain that gives a known word; else the likeliest strict one; else a guess."""
    guess = 0, None, False
    for c, r in made:
        if r is None or known(r):
            return c, r, True
        if not guess[0] or (IS_UTF8[c] and not guess[2]):
            guess = c, r, bool(IS_UTF8[c])
    return guess


def decide(words: dict[str, list[tuple[int, str | None, bool]]]) -> dict[str, Finding]:
    """The finding on each word of a text from (chain, word restored, whether that is known). Of chains that give
    known words, the strict one, then the one that gives most of them in the text is taken."""
    support = Counter(c for made in words.values() for c, _, known in made if known)
    found = {}
    for w, made in words.items():
        if some := [(c, r) for c, r, known in made if known]:
            found[w] = *max(some, key=lambda x: (IS_UTF8[x[0]], support[x[0]])), True
            continue
        c, r, sure = choose([(c, r) for c, r, _ in made], lambda _: False)
        if not sure:
            c, r = max(((c, r) for c, r, _ in made), key=lambda x: support[x[0]])
        found[w] = c, r, sure
    return found


class Model:
    """A multinomial classifier over hashed byte bigrams of words, and the sound words it was fitted on."""

    def __init__(self, texts: list[str]) -> None:
        words = Words(_flat(texts))
        # A word counts once a text, so that no long text outweighs the others.
        counts = Counter(w for w, _ in {(words.word(k), int(words.text_of[k])) for k in range(len(words))})
        self.known: set[str] = set()
        # Some sample texts are garbled themselves: what is taken for garbled is no model of sound text.
        # Strict UTF-8 shows itself at once; the single-byte chains are told by the words known by then.
        for _ in range(2):
            self.table = self._fit(counts)
            found = self.judge(list(counts))
            counts = Counter({w: n for (w, n), (c, _, sure) in zip(counts.items(), found, strict=True) if not (c and sure)})
            self.known = {x for w, n in counts.items() if n > 1 and len(x := core(w)) > 2}
        self.table = self._fit(counts)

    def _fit(self, counts: dict[str, int]) -> np.ndarray:
        tally = np.full((BUCKETS, len(NAMES)), ALPHA)
        for c, chain in enumerate([None, *CHAINS, None]):
            made: Counter[str] = Counter()
            for w, n in counts.items():
                if c == 0:
                    made[w] += n
                elif chain is None:
                    made["".join(LOST if x > "\x7f" else x for x in w)] += n
                    made["".join(LOST * len(x.encode()) if x > "\x7f" else x for x in w)] += n
                elif (g := garble(w, chain)) is not None and g != w:
                    made[g] += n
            if made:
                out = Words(_flat(list(made)))
                weight = np.fromiter(made.values(), float)[out.text_of]
                each = np.repeat(weight, np.diff(np.append(out.first, len(out.code))))
                tally[:, c] += np.bincount(out.code, each, BUCKETS)
        return np.log(tally / tally.sum(0)).astype(np.float32)

    def judge(self, words: list[str]) -> list[Finding]:
        """The finding on each word, by the words known from the sample."""
        found: list[Finding] = [(0, None, False)] * len(words)
        own = Words(_flat(words))
        for k, _, made in self.suspects(own):
            if not found[own.text_of[k]][2]:
                found[own.text_of[k]] = choose(made, self.knows)
        return found

    def knows(self, word: str) -> bool:
        return core(word) in self.known

    def suspects(self, own: Words) -> Iterator[tuple[int, str, Made]]:
        """(number, word, chains) of the words that some likely chain can have made."""
        if not len(own):
            return
        margin = own.scores(self.table)
        margin -= margin[:, :1].copy()
        seen: dict[str, Made] = {}
        for k in np.flatnonzero(margin[:, 1:].max(1) > MARGIN_UTF8):
            w = own.word(k)
            if w not in seen:
                seen[w] = self._undo(w, margin[k])
            if seen[w]:
                yield int(k), w, seen[w]

    def _undo(self, word: str, margin: np.ndarray) -> Made:
        lost = len(NAMES) - 1
        if LOST in word:
            return [(lost, None)]
        made: Made = []
        for c in np.argsort(-margin):
            if c == 0 or c == lost or margin[c] < (MARGIN_UTF8 if IS_UTF8[c] else MARGIN_BYTE):
                continue
            r = restore(word, CHAINS[c - 1])
            if r is not None and r != word:
                made.append((int(c), r))
        return made

    def repair(self, texts: list[str]) -> Iterator[tuple[int, str, int, str | None]]:
        """(number of the text, chain, garbled words, text restored as far as it can be) of garbled texts, by
        the words known from the sample."""
        own = Words(_flat(texts))
        found: dict[int, dict[str, list[tuple[int, str | None, bool]]]] = {}
        for k, w, made in self.suspects(own):
            found.setdefault(int(own.text_of[k]), {})[w] = [(c, r, r is not None and self.knows(r)) for c, r in made]
        for t, words in found.items():
            if done := self.settle(texts[t], decide(words)):
                yield t, *done

    def settle(self, text: str, words: dict[str, Finding]) -> tuple[str, int, str | None] | None:
        """(chain, garbled words, text restored) of a text from the findings on its words; None if it is sound."""
        chains = Counter(c for c, _, sure in words.values() if sure)
        if not chains:
            return None
        back = {w: r for w, (c, r, _) in words.items() if c in chains and r is not None}
        # A text was mostly garbled by one chain: the one that gives most known words goes first.
        whole = [c for c in chains if IS_UTF8[c]]
        all_words = {w for w in WORD.findall(text) if not w.isascii()} if whole else set()
        made = {c: {w: r for w in all_words if (r := restore(w, CHAINS[c - 1])) not in (None, w)} for c in whole}
        strict: dict[str, str] = {}
        for c in sorted(whole, key=lambda c: (sum(map(self.knows, made[c].values())), chains[c], -c)):
            strict |= made[c]
        ways = [(max(chains[c] for c in whole), self.undone(strict))] if whole else []
        if single := [c for c in chains if not IS_UTF8[c] and c != len(NAMES) - 1]:
            c = max(single, key=lambda c: (chains[c], -c))
            ways.append((chains[c], self.likewise(text, c, words)))
        for _, more in sorted(ways, key=lambda way: way[0]):
            back |= more
        restored = WORD.sub(lambda m: back.get(m.group(), m.group()), text) if back else None
        most = min(chains, key=lambda c: (-chains[c], c))
        return NAMES[most], sum(c in chains for c, _, _ in words.values()), restored

    def undone(self, made: dict[str, str]) -> dict[str, str]:
        """Words and what they are restored to, freed of UTF-8 chains that it still shows: some texts were
        garbled more than once."""
        words = list(made.values())
        left = [k for k, w in enumerate(words) if not w.isascii()]
        for _ in range(MOST_STEPS):
            if not left:
                break
            own = Words(_flat([words[k] for k in left]))
            margin = np.zeros((len(left), len(NAMES)), np.float32)
            np.add.at(margin, own.text_of, own.scores(self.table))
            margin -= margin[:, :1].copy()
            again = []
            for n in np.flatnonzero((margin[:, IS_UTF8] > MARGIN_UTF8).any(1)):
                k = left[n]
                likely = [c for c in np.argsort(-margin[n]) if IS_UTF8[c] and margin[n, c] > MARGIN_UTF8]
                better = next((r for c in likely if (r := restore(words[k], CHAINS[c - 1])) not in (None, words[k])), None)
                if better is not None:
                    words[k] = better
                    again.append(k)
            left = [k for k in again if not words[k].isascii()]
        return dict(zip(made, words, strict=True))

    def likewise(self, text: str, c: int, found: dict[str, Finding]) -> dict[str, str]:
        """The words beyond ASCII of a text that the single-byte chain `c`, which is sure for the text, has most
        likely made, each with the word it undoes to. How likely a word is to be garbled before it is looked at
        is the share of such words in the text, which is estimated anew until it stays."""
        undone = {w: r for w in sorted({w for w in WORD.findall(text) if not w.isascii()}) if (r := restore(w, CHAINS[c - 1])) is not None}
        own = Words(_flat(list(undone)))
        margin = np.full(len(undone), -np.inf)
        if len(own):
            scores = own.scores(self.table)
            margin[own.text_of] = scores[:, c] - scores[:, 0]
        margin[[k for k, w in enumerate(undone) if found.get(w, (0,))[0] == c and found[w][2]]] = np.inf
        garbled = margin == np.inf
        for _ in range(ROUNDS):
            share = np.log((garbled.sum() + 0.5) / ((~garbled).sum() + 0.5))
            new = margin + share > 0
            if (new == garbled).all():
                break
            garbled = new
        return {w: r for (w, r), g in zip(undone.items(), garbled, strict=True) if g and r != w}


class Tally(dict):
    """What the words seen lately are counted as."""

    def __missing__(self, word: bytes) -> str:
        if len(self) >= COUNTED:
            self.clear()
        self[word] = key = counted(word.decode("utf-8", "surrogatepass"))
        return key


READ = pa.schema(
    [
        ("id", pa.int64()),
        ("text", pa.string()),
        ("made", pa.list_(pa.struct([("word", pa.string()), ("own", pa.string()), ("c", pa.int32()), ("restored", pa.string()), ("key", pa.string())]))),
        ("key", pa.string()),
        ("n", pa.int64()),
    ]
)
READ_SQL = "id long, text string, made array<struct<word: string, own: string, c: int, restored: string, key: string>>, key string, n long"


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= BLOCK):
            size += len(texts[high])
            high += 1
        yield low, high
        low = high


def _read(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two kinds: a text with what may have made its words; a word's key and texts that hold it."""

    def batch(columns: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in READ], schema=READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, counts = shared.value, Tally(), Counter()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for low, high in _parts(texts):
                own = Words(_flat(texts[low:high]))
                blob, places = own.blob, zip(own.text_of.tolist(), own.low.tolist(), own.high.tolist(), strict=True)
                counts.update(key for _, key in {(t, keys[blob[i:j]]) for t, i, j in places})
                made: dict[int, dict[str, list]] = {}
                for k, w, chains in model.suspects(own):
                    words = made.setdefault(low + int(own.text_of[k]), {})
                    if w not in words:
                        words[w] = [{"word": w, "own": counted(w), "c": c, "restored": r, "key": evidence(w, r)} for c, r in chains]
                if made:
                    yield batch({"id": [ids[t] for t in made], "text": [texts[t] for t in made], "made": [sum(x.values(), []) for x in made.values()]}, len(made))
                if len(counts) >= COUNTED:
                    yield batch({"key": list(counts), "n": list(counts.values())}, len(counts))
                    counts.clear()
        if counts:
            yield batch({"key": list(counts), "n": list(counts.values())}, len(counts))

    return run


def _settle(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = []
            for i, text, marked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made: dict[str, list[tuple[int, str | None, bool]]] = {}
                for x in sorted(marked, key=lambda x: x["at"]):
                    made.setdefault(x["word"], []).append((x["c"], x["restored"], x["known"]))
                if done := model.settle(text, decide(made)):
                    rows.append((i, *done))
            if rows:
                i, chain, n, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(chain), pa.array(n, pa.int32()), pa.array(text, pa.string())], ["id", "chain", "n_words", "restored"])

    return run


def fit(docs: DataFrame, text: str) -> Model:
    """A model of the texts of `docs`, fitted on SAMPLE_TEXTS different ones beyond ASCII that a hash picks."""
    t = F.col("text")
    some = docs.select(F.col(text).alias("text")).where(F.octet_length(t) > F.char_length(t)).withColumn("h", F.xxhash64("text"))
    n = some.agg(F.approx_count_distinct("h")).first()[0]
    # The share of all hashes that holds the sample and half as much again, so that no task or the driver
    # gathers more than that, however many texts there are.
    share = min(1.0, 1.5 * SAMPLE_TEXTS / max(n, 1))
    own = some.where(F.col("h") <= int(-(2**63) + share * (2**64 - 4096))).select("h", F.substring(t, 1, SAMPLE_CHARS).alias("text"))
    rows = own.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(SAMPLE_TEXTS).collect()
    return Model([r["text"] for r in rows])


def garbled_texts(docs: DataFrame, idx: str, text: str, model: Model | None = None) -> DataFrame:
    """(`idx`, `chain`, `n_words`, `restored`) of every text that holds words read with a wrong encoding.

    A multinomial classifier over hashed byte bigrams is fitted on words beyond ASCII of a bounded sample of
    the texts and on what each chain of CHAINS makes of them. It names the likeliest chains of each word of
    every whole text; a chain is taken if it can be undone strictly, and, where its inverse is a single-byte
    encoding, gives a word that at least two of all texts hold, and more than hold the word as it stands.
    Words with replacement characters are garbled beyond repair.
    `chain` is the commonest of the text, `n_words` its number of different garbled words, `restored` the
    whole text with every word put right that can be; null if there is none.

    Null and empty texts and ASCII texts are sound. Null ids are reported as null, repeated rows each on
    their own. A table without texts beyond ASCII has no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(idx).cast("long").alias("id"), F.col(text).alias("text"))
    rows = spread(rows.where(F.octet_length("text") > F.char_length("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text))
    read = cut_lineage(rows.mapInArrow(_read(shared), READ_SQL).withColumn("row", F.monotonically_increasing_id()))
    suspects = read.where("key IS NULL").select("row", "id", "text", "made")
    each = suspects.select("row", F.posexplode("made").alias("at", "x")).select("row", "at", "x.*")
    found = each.join(_known(each, read), ["own", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    strict = [c for c in range(1, len(NAMES)) if IS_UTF8[c] or c == len(NAMES) - 1]
    marked = found.groupBy("row").agg(F.collect_list(F.struct("at", "word", "c", "restored", "known")).alias("marked"), F.max(F.col("known") | F.col("c").isin(strict)).alias("sure")).where("sure")
    done = suspects.join(marked, "row").select("id", "text", "marked").mapInArrow(_settle(shared), "id long, chain string, n_words int, restored string")
    return done.withColumnRenamed("id", idx)


def _known(each: DataFrame, read: DataFrame) -> DataFrame:
    """(`own`, `key`, `known`): the pairs of a word and what it is restored to of which the texts hold the latter
    at least twice, and more often than the word itself; SHORT_TIMES as often where it is short."""
    counts = read.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = each.where("key IS NOT NULL").select("own", "key").distinct()
    sides = pairs.join(counts, "key").join(counts.select(F.col("key").alias("own"), F.col("n").alias("n_own")), "own")
    times = F.when(F.char_length("key") <= SHORT, SHORT_TIMES).otherwise(1)
    return sides.where((F.col("n") >= 2) & (F.col("n") > times * F.col("n_own"))).select("own", "key", F.lit(True).alias("known"))
