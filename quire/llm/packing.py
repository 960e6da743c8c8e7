"""Best-fit packing by linear grouping.

1. Texts become pieces of at most 1024 tokens; only (length, count) pairs, at
   most 1024 of them, come to the driver.
2. Large lengths, those of which a sequence holds two at most, stand in groups of
   equal cardinality, each rounded up to its longest, so few sizes remain. A
   linear programme over configurations (sets of sizes that fit one sequence) is
   solved by column generation with a knapsack.
3. Whole configurations are laid out and actual lengths take the rounded slots. A
   slot takes the longest length left that keeps the later slots' room, so the
   room that rounding cost is handed on. What no whole configuration holds is
   grouped anew, more finely as less is left, and solved again.
4. When no configuration is whole any more, the rest and the small lengths are
   placed by best fit, longest first, in the room that remains.
5. The plan is a list of runs of equal sequences. A piece finds its place by its
   length and its number among the pieces of that length.

Room is counted, not searched: the plan's size depends on the number of
lengths and groups, not on the number of documents.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe
from quire.llm._spark import cut, lean, numbered, table

ROOM = 1024
END_ID = 2
GROUPS = 128
#: Lengths of at least this many tokens are large: more than a third of the room.
LARGE = 342


def pieces_of(ids: np.ndarray, room: int = ROOM) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces; the first takes what isn't a multiple of the room."""
    n = len(ids)
    if n <= room:
        return [(0, ids)]
    cuts = [0, *range(n % room or room, n + 1, room)]
    return [(a, ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """matrix @ x without the threads of a BLAS library: in a driver that has forked they may wait for each other for ever."""
    return (matrix * x).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps with row pivots, for the same reason."""
    k = len(matrix)
    work = np.concatenate([matrix, np.eye(k)], axis=1)
    for j in range(k):
        p = j + int(np.abs(work[j:, j]).argmax())
        if p != j:
            work[[j, p]] = work[[p, j]]
        work[j] /= work[j, j]
        factor = work[:, j].copy()
        factor[j] = 0
        work -= np.outer(factor, work[j])
    return work[:, k:]


def _simplex(sizes: list[int], demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, by column generation on the covering programme."""
    k = len(sizes)
    size = np.array(sizes)
    basis = np.diag(room // size).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    use = _times(inverse, demand)
    for step in range(40 * k):
        price = np.maximum(inverse.sum(axis=0), 0)  # all costs are 1
        # unbounded knapsack: the best price for each room, one size after the other
        best = np.zeros(room + 1)
        took = np.full(room + 1, -1)
        for i in range(k):
            s = sizes[i]
            if price[i] <= 1e-12:
                continue
            for _ in range(room // s):
                alt = best[:-s] + price[i]
                gain = alt > best[s:] + 1e-12
                if not gain.any():
                    break
                best[s:][gain] = alt[gain]
                took[s:][gain] = i
        if best[room] <= 1 + 1e-7:
            break
        column, r = np.zeros(k), room
        while r > 0 and best[r] > 1e-12:
            i = int(took[r])
            if i < 0:
                r -= 1
                continue
            column[i] += 1
            r -= sizes[i]
        if (column * price).sum() <= 1 + 1e-7:
            break
        move = _times(inverse, column)
        ratio = np.where(move > 1e-9, use / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / move[out]
        theta = ratio[out]
        use = use - theta * move
        use[out] = theta
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        if step % 50 == 49:
            inverse = _inverse(basis)
            use = _times(inverse, demand)
    return [(basis[:, j].round().astype(int), float(use[j])) for j in range(k) if use[j] > 1e-9]


class Rooms:
    """Runs of sequences by free room; a run is (first, number, items as ((length, offset), ...))."""

    def __init__(self, room: int) -> None:
        self.room, self.runs, self.free = room, [[] for _ in range(room + 1)], []
        self.made = 0

    def put(self, free: int, first: int, number: int, items: tuple) -> None:
        if not self.runs[free]:
            bisect.insort(self.free, free)
        self.runs[free].append((first, number, items))

    def take(self, free: int, number: int) -> tuple[int, int, tuple]:
        """At most `number` equal sequences of that room."""
        first, have, items = self.runs[free].pop()
        if have > number:
            self.runs[free].append((first + number, have - number, items))
            have = number
        if not self.runs[free]:
            self.free.pop(bisect.bisect_left(self.free, free))
        return first, have, items

    def new(self, number: int) -> tuple[int, int, tuple]:
        self.made += number
        return self.made - number, number, ()

    def slots(self) -> list[tuple[int, int, int, int]]:
        """(length, first sequence, number of sequences, offset) of everything that is placed."""
        return [(n, first, number, at) for runs in self.runs for first, number, items in runs for n, at in items]

    def best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect.bisect_left(self.free, length)
            if i < len(self.free):
                free = self.free[i]
                first, n, items = self.take(free, count)
            else:
                free = self.room
                each = self.room // length
                first, n, items = self.new(max(1, count // each) if count >= each else 1)
            at = self.room - free
            fit = 1 if items or n > count else min(free // length, max(1, count // n))
            items = (*items, *((length, at + length * j) for j in range(fit)))
            count -= n * fit
            self.put(free - length * fit, first, n, items)


def grouped(left: dict[int, int], large: int, groups: int) -> tuple[list[int], np.ndarray]:
    """The sizes that large lengths are rounded up to, longest first, and how many pieces each has."""
    big = sorted((n for n in left if n >= large), reverse=True)
    per = max(1, -(-sum(left[n] for n in big) // groups))
    sizes: list[int] = []
    demand: list[int] = []
    seen = 0
    for n in big:
        count = left[n]
        while count:
            # a group begins with its longest; equal sizes are one
            if seen % per == 0 and (not sizes or sizes[-1] != n):
                sizes.append(n)
                demand.append(0)
            got = min(count, per - seen % per)
            demand[-1] += got
            seen, count = seen + got, count - got
    return sizes, np.array(demand, dtype=float)


def _lay_out(rooms: Rooms, left: dict[int, int], slots: list[int], times: int) -> int:
    """Up to `times` sequences with these rounded slots, longest first; the number of pieces they took from `left`."""
    lengths, taken = sorted(left), 0
    while times > 0:
        # a run of sequences with equal actual lengths lasts until one of them is used up
        at, later, used, items = 0, sum(slots), {}, []
        for slot in slots:
            later -= slot
            i = bisect.bisect_right(lengths, rooms.room - at - later) - 1
            while i >= 0 and left[lengths[i]] <= used.get(lengths[i], 0):
                i -= 1
            if i >= 0:
                n = lengths[i]
                used[n] = used.get(n, 0) + 1
                items.append((n, at))
                at += n
        if not items:
            break
        run = min(times, *(left[n] // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= run * k
            taken += run * k
            if not left[n]:
                del left[n]
                lengths.remove(n)
        first, number, _ = rooms.new(run)
        rooms.put(rooms.room - at, first, number, tuple(items))
        times -= run
    return taken


def plan(histogram: dict[int, int], room: int = ROOM, groups: int = GROUPS, large: int = LARGE) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots (length, first sequence, number of sequences, offset) for all pieces, and the number of sequences."""
    rooms = Rooms(room)
    left = {n: c for n, c in histogram.items() if c > 0}
    if full := left.pop(room, 0):
        first, number, _ = rooms.new(full)
        rooms.put(0, first, number, ((room, 0),))
    taken = 1
    while taken:
        taken = 0
        sizes, demand = grouped(left, large, groups)
        for config, use in sorted(_simplex(sizes, demand, room), key=lambda x: (-x[1], tuple(x[0]))) if sizes else ():
            taken += _lay_out(rooms, left, [s for s, q in zip(sizes, config, strict=True) for _ in range(int(q))], int(use + 1e-9))
    for n in sorted(left, reverse=True):
        rooms.best_fit(n, left[n])
    return rooms.slots(), rooms.made


def _tokenised(path: str, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.byte_ids(path)
        end = np.array([END_ID], dtype=np.uint32)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist()), strict=True):
                    for k, (start, piece) in enumerate(pieces_of(np.concatenate([ids, end]), room)):
                        for col, v in zip(rows, (doc, k, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes())), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """docs(doc_id, text) -> pieces with sequence_id and offset.

    Defined results: a null or empty text is one piece of the end id alone;
    repeated rows are packed one by one; other columns are ignored; an empty
    table gives an empty table. A text of any length is tokenised whole by one
    task, and becomes as many pieces as it needs. Pieces of equal length are
    dealt to their slots by id, number and checksum; those that tie in all three
    are alike.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    spec = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_tokenised(path, room)), spec), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = plan(histogram, room)
    # the slots of a length, one after the other: piece number r of length n is in the slot whose running count it falls in
    lengths = np.array([s[0] for s in slots], dtype=np.int64)
    order = np.lexsort((np.array([s[3] for s in slots]), np.array([s[1] for s in slots]), lengths)) if slots else np.zeros(0, dtype=np.int64)
    table_ = np.array(slots, dtype=np.int64).reshape(-1, 4)[order]
    before = np.cumsum(table_[:, 2]) - table_[:, 2]
    first = {}
    for i, n in enumerate(table_[:, 0].tolist()):
        first.setdefault(n, int(before[i]))
    base = np.zeros(room + 1, dtype=np.int64)
    for n, b in first.items():
        base[n] = b

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            where = base[length] + rank
            slot = np.searchsorted(before, where, side="right") - 1
            own = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_arrays([*own.values(), pa.array(table_[slot, 1] + where - before[slot]), pa.array(table_[slot, 3])], names=[*own, "sequence_id", "offset"])

    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(place), spec + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
