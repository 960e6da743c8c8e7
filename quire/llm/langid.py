"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters; one of more than `PIECE` letters is as many steps of
the chain as it has pieces of like length, so all of its letters count, and each
piece counts as a word. A word's features are its affixes, inner character n-grams and membership in
each language's lexicon of frequent words; transitions between the labels of
neighbouring words are learned with them. Training chains are made of spans of
different documents, so the model sees text that switches language. A whole
text is labelled by forward-backward; its language is the label with the
greatest share of the words' marginals.

Only a bounded sample of labelled rows is learned from (`per_language` whole
texts of at most `most_bytes` each); every document is labelled. Emission scores
are kept per distinct word, and the chains of a batch run in step, so the cost
per word is a few array operations.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _text
from quire.llm._spark import lean, table

BUCKETS = 1 << 16
PER_LANGUAGE = 120
MOST_BYTES = 262_144
LEXICON = 300
SPAN, SPANS, CHAINS, ROUNDS = 12, 4, 700, 40
UNKNOWN = "und"
#: A longer run of letters is a chain of pieces.
PIECE = 40


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case where it is one character."""
    letter = np.zeros(0x110000, dtype=bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            t = s.lower()
            if len(t) == 1:
                low[c] = ord(t)
    return letter, low


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, starts and ends of the letter runs or their pieces, and each text's first one (one more at the end)."""
    letter, low = _letters()
    cps, off = _text.codes(texts)
    is_word = letter[cps]
    edge = np.zeros(len(cps) + 1, dtype=bool)
    edge[off] = True
    if not len(cps):
        none = np.zeros(0, dtype=np.int64)
        return cps, none, none, np.zeros(len(off), dtype=np.int64)
    start = np.flatnonzero(is_word & (~np.r_[False, is_word[:-1]] | edge[:-1]))
    stop = np.flatnonzero(is_word & (~np.r_[is_word[1:], False] | edge[1:])) + 1
    size = stop - start
    pieces = -(-size // PIECE)
    if (pieces > 1).any():
        n = np.repeat(pieces, pieces)
        k = np.arange(len(n)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, size = np.repeat(start, pieces), np.repeat(size, pieces)
        start, stop = begin + size * k // n, begin + size * (k + 1) // n
    return low[cps], start, stop, np.searchsorted(start, off)


def features(word: str, lexicons: list[frozenset[str]]) -> list[int]:
    w = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3, 4)] + [f"s{word[-k:]}" for k in (1, 2, 3, 4)]
    names += [f"g{w[i : i + n]}" for n in (2, 3) for i in range(len(w) - n + 1)]
    names += [f"l{k}" for k, lex in enumerate(lexicons) if word in lex] + ["b"]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray
    lexicons: list[frozenset[str]]

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Emission scores of distinct words."""
        lists = [features(t, self.lexicons) for t in tokens]
        lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter((i for f in lists for i in f), dtype=np.int64, count=int(lens.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(lens) - lens, axis=0)


def marginals(emit: np.ndarray, lens: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over padded chains: emit is chains x steps x labels (scores); lens are the chains' lengths."""
    n, steps, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    move = np.exp(transitions)
    forward, back = np.empty_like(e), np.ones_like(e)
    now = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    forward[:, 0] = now
    for t in range(1, steps):
        now = (now @ move) * e[:, t]
        now /= now.sum(axis=1, keepdims=True)
        forward[:, t] = now
    now = np.ones((n, k), dtype=e.dtype)
    for t in range(steps - 2, -1, -1):
        now = (now * e[:, t + 1]) @ move.T
        now /= now.sum(axis=1, keepdims=True)
        now = np.where((t + 1 < lens)[:, None], now, 1.0)
        back[:, t] = now
    both = forward * back
    return both / both.sum(axis=2, keepdims=True)


def train(sample: list[tuple[str, str]], seed: int = 7, rounds: int = ROUNDS) -> Crf | None:
    """Fit on (text, language) rows by gradient steps on the chains' likelihood."""
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    by: list[list[list[str]]] = [[] for _ in languages]
    for text, lang in sample:
        low, start, stop, _ = words([text])
        own = [low[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        by[languages.index(lang)] += [own[i : i + SPAN] for i in range(0, len(own), SPAN) if own[i : i + SPAN]]
    present = [k for k, spans in enumerate(by) if spans]
    counts = [Counter(w for s in spans for w in s) for spans in by]
    lexicons = [frozenset(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) for c in counts]
    k = len(languages)
    model = Crf(languages, np.zeros((BUCKETS, k)), np.zeros((k, k)), lexicons)
    if not present:
        return model
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    steps = SPAN * SPANS
    ids, gold = np.zeros((CHAINS, steps), dtype=np.int64), np.zeros((CHAINS, steps), dtype=np.int64)
    lens = np.zeros(CHAINS, dtype=np.int64)
    for c in range(CHAINS):
        row: list[tuple[str, int]] = []
        lang = present[rng.integers(len(present))]
        for _ in range(SPANS):
            if rng.random() < 0.4:
                lang = present[rng.integers(len(present))]
            row += [(w, lang) for w in by[lang][rng.integers(len(by[lang]))]]
        lens[c] = len(row)
        for t, (w, y) in enumerate(row):
            ids[c, t], gold[c, t] = vocabulary.setdefault(w, len(vocabulary)), y
    lists = [features(w, lexicons) for w in vocabulary]
    width = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((i for f in lists for i in f), dtype=np.int64, count=int(width.sum()))
    at, owner = np.cumsum(width) - width, np.repeat(np.arange(len(lists)), width)
    real = np.arange(steps)[None, :] < lens[:, None]
    pair = real[:, 1:]
    # Adam on emission weights and transitions
    m1, m2 = np.zeros_like(model.weights), np.zeros_like(model.weights)
    a1, a2 = np.zeros((k, k)), np.zeros((k, k))
    onehot = np.eye(k)
    for step in range(1, rounds + 1):
        emit = np.add.reduceat(model.weights[flat], at, axis=0)[ids] * real[:, :, None]
        post = marginals(emit, lens, model.transitions)
        wrong = (post - onehot[gold]) * real[:, :, None]
        per_word = np.stack([np.bincount(ids.ravel(), weights=wrong[:, :, y].ravel(), minlength=len(lists)) for y in range(k)], axis=1)
        grad = np.stack([np.bincount(flat, weights=per_word[owner, y], minlength=BUCKETS) for y in range(k)], axis=1) / CHAINS + 1e-4 * model.weights
        # expected transitions from neighbouring marginals, against those seen
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
        joint = post[:, :-1, :, None] * post[:, 1:, None, :] * np.exp(model.transitions)
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        move = ((joint * pair[:, :, None, None]).sum(axis=(0, 1)) - seen) / CHAINS + 1e-3 * model.transitions
        for value, g, x1, x2, rate in ((model.weights, grad, m1, m2, 0.08), (model.transitions, move, a1, a2, 0.1)):
            x1 += 0.1 * (g - x1)
            x2 += 0.01 * (g * g - x2)
            value -= rate * (x1 / (1 - 0.9**step)) / (np.sqrt(x2 / (1 - 0.99**step)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


class Labeller:
    def __init__(self, model: Crf) -> None:
        self.model = model
        self.known = np.zeros((1 << 14, len(model.languages)), dtype=np.float32)
        self.n = 0
        self.memo = _text.Memo(self._learn, self._forget, 1_000_000)

    def _learn(self, tokens: list[str]) -> None:
        if self.n + len(tokens) > len(self.known):
            self.known = np.concatenate([self.known[: self.n], np.zeros((self.n + 2 * len(tokens), self.known.shape[1]), dtype=np.float32)])
        self.known[self.n : self.n + len(tokens)] = self.model.scores(tokens)
        self.n += len(tokens)

    def _forget(self) -> None:
        self.n = 0

    def label(self, texts: list[str | None], spans: bool = False) -> list[tuple]:
        """(language, score, words, switches[, labels of words with their ends]) of each text."""
        out: list[tuple] = []
        for a, b in _text.groups(texts, 1 << 22):
            low, start, stop, first = words(texts[a:b])
            off = np.cumsum([0, *(len(t) if t else 0 for t in texts[a:b])])
            num = self.memo.numbers(low, start, stop) if len(start) else np.zeros(0, dtype=np.int64)
            lens = np.diff(first)
            rows: list[tuple] = [(UNKNOWN, 0.0, 0, 0, [])] * (b - a)
            order = np.argsort(lens, kind="stable")
            order = order[lens[order] > 0]
            at = 0
            while at < len(order):
                # chains of like length together: at most about 300,000 cells
                stop_at = at + 1
                while stop_at < len(order) and (stop_at + 1 - at) * int(lens[order[stop_at]]) <= 300_000:
                    stop_at += 1
                own = order[at:stop_at]
                at = stop_at
                n, steps = len(own), int(lens[own].max())
                cell = np.arange(steps)[None, :]
                real = cell < lens[own][:, None]
                where = np.where(real, first[own][:, None] + cell, 0)
                post = marginals(self.known[num[where]] * real[:, :, None], lens[own], self.model.transitions.astype(np.float32))
                share = (post * real[:, :, None]).sum(axis=1, dtype=np.float64) / lens[own][:, None]
                best = share.argmax(axis=1)
                labels = post.argmax(axis=2)
                turns = ((labels[:, 1:] != labels[:, :-1]) & real[:, 1:]).sum(axis=1)
                for r, i in enumerate(own.tolist()):
                    detail = list(zip((start[first[i] : first[i + 1]] - off[i]).tolist(), (stop[first[i] : first[i + 1]] - off[i]).tolist(), [self.model.languages[y] for y in labels[r, : lens[i]]], strict=True)) if spans else []
                    rows[i] = (self.model.languages[best[r]], min(1.0, float(share[r, best[r]])), int(lens[i]), int(turns[r]), detail)
            out += rows
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES) -> Crf | None:
    """Fit on the labelled rows outside the held-out third: the first `per_language` of each language in hash order."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") <= most_bytes))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("crf")), F.lit(1 << 40))
    # a bar per language that about twice the wanted rows pass, and then the first of them
    bars = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * per_language / n + 20 / n) * (1 << 40)))])
    found = rows.where(place < F.element_at(bars, F.col("lang"))).select("text", "lang", place.alias("place")).collect()
    kept: dict[str, int] = {}
    sample = []
    for r in sorted(found, key=lambda r: (r["place"], r["text"])):
        if kept.setdefault(r["lang"], 0) < per_language:
            kept[r["lang"]] += 1
            sample.append((r["text"], r["lang"]))
    return train(sample)


def identify(docs: DataFrame, model: Crf | None, spans: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, n_words, n_switches[, spans of words].

    Defined results: a null text, one without letters, or any text where there
    was nothing to learn from, is `und` with score 0; repeated rows are labelled
    one by one; other columns are ignored; an empty table gives an empty table.
    """
    spec = "doc_id long, lang_pred string, score double, n_words long, n_switches long"
    names = ["doc_id", "lang_pred", "score", "n_words", "n_switches"]
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(model) if model else None
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                texts = part.column("text").to_pylist()
                rows = own.label(texts, spans) if own else [(UNKNOWN, 0.0, 0, 0, [])] * len(texts)
                cols = list(zip(*rows, strict=True))
                arrays = [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols[:4], (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))]
                if spans:
                    arrays.append(pa.array([[{"start": x, "end": y, "lang": z} for x, y, z in d] for d in cols[4]], shape))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["words"] * spans)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), spec + ", words array<struct<start:long,end:long,lang:string>>" * spans)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
