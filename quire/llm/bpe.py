"""Token counts by heap-and-linked-list byte-pair merging, and token ids for packing.

Counting never makes an id: a token's symbols stand in a linked list, adjacent
pairs that are pieces wait in a heap by rank, the lowest rank is merged first
(the leftmost of equals), and the count is the number of initial symbols minus
that of merges. A symbol that stays alone and is no piece counts as its UTF-8
bytes (byte fallback).

Texts are cut where no piece can cross: between two characters that are
adjacent in no piece. Each distinct cut is merged once per worker; occurrences
are array look-ups.
"""

from __future__ import annotations

import functools
import heapq
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _text
from quire.llm._spark import lean, table

LIMIT = 4096
SPACE = "▁"


def _fields(buf: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x, i
            shift += 7

    i = 0
    while i < len(buf):
        tag, i = varint(i)
        if tag & 7 == 2:
            n, i = varint(i)
            yield tag >> 3, 2, buf[i : i + n]
            i += n
        elif tag & 7 == 5:
            yield tag >> 3, 5, struct.unpack("<f", buf[i : i + 4])[0]
            i += 4
        elif tag & 7 == 1:
            i += 8
        else:
            v, i = varint(i)
            yield tag >> 3, 0, v


@functools.cache
def pieces(path: str) -> dict[str, float]:
    """The model's mergeable pieces with their ranks; a lower rank merges first."""
    found = {}
    with open(path, "rb") as f:
        model = f.read()
    for field, _, value in _fields(model):
        if field == 1:
            own = {k: v for k, _, v in _fields(value)}
            if own.get(3, 1) in (1, 4, 5):  # normal, user-defined, unused
                found[own[1].decode()] = -own.get(2, 0.0)
    return found


def merged_count(token: str, ranks: dict[str, float]) -> int:
    """Tokens that byte-pair merging leaves of one cut."""
    n = len(token)
    if n == 1:
        return 1 if token in ranks else len(token.encode("utf-8", "surrogatepass"))
    sym: list[str | None] = list(token)
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := token[i : i + 2]) in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, p = heapq.heappop(heap)
        left = sym[i]
        if left is None or (j := nxt[i]) < 0 or len(left) + len(sym[j]) != len(p):
            continue  # one side has been merged meanwhile
        sym[i], sym[j] = p, None
        merges += 1
        nxt[i] = k = nxt[j]
        if k >= 0:
            prev[k] = i
            if (q := p + sym[k]) in ranks:
                heapq.heappush(heap, (ranks[q], i, q))
        if (h := prev[i]) >= 0 and (q := sym[h] + p) in ranks:
            heapq.heappush(heap, (ranks[q], h, q))
    alone = sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in sym if s is not None and len(s) == 1 and s not in ranks)
    return n - merges + alone


class Counter:
    """Token counts of texts under one model; keeps what it learns about distinct cuts."""

    def __init__(self, path: str) -> None:
        self.ranks = pieces(path)
        chars = sorted({c for p in self.ranks if len(p) > 1 for c in p})
        self.number = np.zeros(0x110000, dtype=np.int16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        at = {c: i for i, c in enumerate(chars, 1)}
        for p in self.ranks:
            for a, b in zip(p, p[1:]):  # noqa: B905
                self.joined[at[a], at[b]] = True
        self.known = np.zeros(1 << 16, dtype=np.int64)
        self.n = 0
        self.memo = _text.Memo(self._learn, self._forget)

    def _learn(self, tokens: list[str]) -> None:
        if self.n + len(tokens) > len(self.known):
            self.known = np.resize(self.known, 2 * (self.n + len(tokens)))
        self.known[self.n : self.n + len(tokens)] = [merged_count(t, self.ranks) for t in tokens]
        self.n += len(tokens)

    def _forget(self) -> None:
        self.n = 0

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text: a blank is put before a text that isn't empty, and blanks are the space piece."""
        out = []
        for a, b in _text.groups(texts):
            cps, off = _text.codes([" " + t if t else "" for t in texts[a:b]])
            if not len(cps):
                out.append(np.zeros(b - a, dtype=np.int64))
                continue
            cps = np.where(cps == 32, np.uint32(ord(SPACE)), cps)
            num = self.number[cps]
            start = np.ones(len(cps), dtype=bool)
            start[1:] = ~self.joined[num[:-1], num[1:]]
            start[off[:-1][off[:-1] < len(cps)]] = True
            at = np.flatnonzero(start)
            num = self.memo.numbers(cps, at)  # may renew self.known
            out.append(_text.segment_sums(self.known[num], np.searchsorted(at, off)))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, over whole texts, in one narrow stage.

    Defined results: null and empty texts have 0 bytes and 0 tokens; repeated
    rows are counted one by one; other columns are ignored; an empty table gives
    an empty table.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(own.counts(part.column("text").to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- ids of the byte-level vocabulary -------------------------------------------------

#: Character classes of the byte-level pre-tokeniser.
LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
#: A worker remembers about so many distinct cuts, and so many of their ids, before it begins anew.
CUTS, CUT_IDS = 300_000, 2_000_000
#: Characters of one array step.
CHARS = 1 << 18


@functools.cache
def _classes() -> np.ndarray:
    """Classes of the code points below 0x250; everything above, and the apostrophe, is left to the library."""
    out = np.full(0x250, OTHER, dtype=np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else BLANK if chr(c).isspace() and not 0x1C <= c <= 0x1F else OTHER
    return out


class ByteIds:
    """Ids of texts under a byte-level vocabulary, exactly as the tokenizers library gives them.

    Texts of plain characters are cut by array operations as the library's
    pattern cuts them, and each distinct cut is encoded once. A text with an
    apostrophe, a character beyond Latin Extended-B or a special token's string
    goes through the library as a whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # the model sees each byte as a character: printable Latin-1 as it is, the others from U+0100 on in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: 256 + k for k, b in enumerate(others)}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._forget()
        self.memo = _text.Memo(self._learn, self._forget, CUTS)

    def _forget(self) -> None:
        self.ids, self.at, self.lens, self.n, self.used = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0, 0

    def _learn(self, tokens: list[str]) -> None:
        cut, shown = self.library.model.tokenize, self.shown
        found = [[t.id for t in cut(token.encode().decode("latin-1").translate(shown))] for token in tokens]
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for f in found for i in f), dtype=np.uint32, count=int(lens.sum()))
        if self.n + len(found) > len(self.at):
            size = 2 * (self.n + len(found))
            self.at, self.lens = np.resize(self.at, size), np.resize(self.lens, size)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
        self.at[self.n : self.n + len(found)] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : self.n + len(found)] = lens
        self.ids[self.used : self.used + len(flat)] = flat
        self.n += len(found)
        self.used += len(flat)

    def _bounded(self) -> None:
        if self.used > CUT_IDS:
            self.memo.clear()

    def _odd(self, text: str) -> bool:
        return "'" in text or any(s in text for s in self.special)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        empty = np.zeros(0, dtype=np.uint32)
        for a, b in _text.groups(texts, CHARS):
            own = texts[a:b]
            cps, off = _text.codes(own)
            high = _text.segment_sums((cps >= 0x250).astype(np.int64), off) if len(cps) else np.zeros(b - a, dtype=np.int64)
            slow = [bool(t) and (high[i] > 0 or self._odd(t)) for i, t in enumerate(own)]
            if any(slow):
                cps, off = _text.codes([None if s else t for s, t in zip(slow, own, strict=True)])
            if len(cps):
                at = self._starts(cps, off)
                self._bounded()
                num = self.memo.numbers(cps, at)
                lens = self.lens[num]
                ids = self.ids[_text.ragged(self.at[num], lens)]
                stops = np.r_[0, np.cumsum(lens)][np.searchsorted(at, off)]
            for i in range(b - a):
                if slow[i]:
                    out.append(np.array(self.library.encode(own[i], add_special_tokens=False).ids, dtype=np.uint32))
                else:
                    out.append(ids[stops[i] : stops[i + 1]] if own[i] else empty)
        return out

    @staticmethod
    def _starts(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where tokens begin: at changes of class; a blank (U+0020) before a run belongs to it; of a longer run of white space the last character stands apart unless the text ends there."""
        kind = _classes()[cps]
        first = np.zeros(len(cps) + 1, dtype=bool)
        first[off] = True
        blank = kind == BLANK
        prev_kind = np.r_[np.uint8(255), kind[:-1]]
        prev_space = np.r_[False, cps[:-1] == 32]
        starts = np.where(blank, prev_kind != BLANK, np.where(prev_kind == BLANK, ~prev_space, prev_kind != kind))
        next_solid = np.r_[~blank[1:], False] & ~first[1:]
        starts |= blank & next_solid
        starts |= first[:-1]
        return np.flatnonzero(starts)


@functools.cache
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)
