"""MinHash near-duplicate groups by one-permutation hashing.

1. Signature. A document's set is its distinct 5-word shingles as 64-bit
   hashes. One permutation splits the hash range into 252 bins; a bin's value is
   its smallest hash. An empty bin borrows from a full bin that its own random
   order of bins names (optimal densification: uniform and independent donors).
2. Equal sets fold into their smallest document before anything is paired.
3. Bands of 7 bins are bucket keys. A bucket gives a star of candidate edges:
   every member to the bucket's smallest, its hub, so n members make n - 1 edges
   and not n * (n - 1) / 2. At similarity 0.85 a pair misses all 36 bands with
   probability (1 - 0.85^7)^36 < 1e-6.
4. Candidate edges are confirmed on full sets, and the components of the
   confirmed links joined. A bucket is decided when all that is left in it belongs
   to one component, as in most groups of copies.
5. Members that share undecided buckets form clusters. What lies outside of a
   cluster's largest component, the outsiders, is compared with all of the
   cluster, in blocks of bounded size: exact counts of common shingles for all
   pairs of two blocks are products of incidence matrices.
6. Components of all confirmed links are the result.

No link between two members of a bucket is lost: they are connected by then, or
one of them is an outsider of their cluster. Nothing grows with the square of a
group of copies that link to its hub; what doesn't link costs outsiders times
members, a few operations each, in blocks that are independent tasks. A hub's
members are dealt to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _text
from quire.llm._spark import cut, drop_cut, lean, looked_up, table

U = np.uint64
SHINGLE = 5
BANDS, ROWS = 36, 7
BINS = BANDS * ROWS
PERCENT = 85
#: Documents and shingles of a block of outsiders or members, and columns of an incidence matrix at once.
BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 1 << 13
#: Members that one task compares with a hub, at least; a hub of n members is sent to n / max(this, sqrt(n)) tasks.
STAR = 256
#: Edges of which one task makes a forest.
FOREST = 200_000

_rng = np.random.default_rng(20240607)
#: Each bin's own order of all bins, as ranks.
_DONORS = np.argsort(_rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
_EDGES = ((np.arange(BINS, dtype=object) * (1 << 64) + BINS - 1) // BINS).astype(U)


def shingle_hashes(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words lower-cased in A-Z.

    With fewer than k words the whole sequence is one shingle; without words the
    set is empty.
    """
    out: list[np.ndarray] = []
    for a, b in _text.groups(texts):
        cps, off = _text.codes(texts[a:b])
        low = np.where((cps >= 65) & (cps <= 90), cps + np.uint32(32), cps)
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[off] = True
        before = np.r_[False, word[:-1]] if len(word) else word
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.r_[word[1:], False] if len(word) else word
        stop = np.flatnonzero(word & (~after | edge[1:])) + 1
        h = _text.token_hashes(low, start, stop) if len(start) else np.zeros(0, dtype=U)
        first = np.searchsorted(start, off)
        with np.errstate(over="ignore"):
            roll = np.zeros(len(h), dtype=U)
            for j in range(k):
                if len(h) > j:
                    roll[: len(h) - j] = roll[: len(h) - j] * U(0x100000001B3) + h[j:]
            roll = _text.mix(roll)
        for i in range(b - a):
            x, y = int(first[i]), int(first[i + 1])
            if y - x >= k:
                out.append(np.unique(roll[x : y - k + 1]))
            elif y > x:
                whole = U(y - x)
                with np.errstate(over="ignore"):
                    for v in h[x:y]:
                        whole = whole * U(0x100000001B3) + v
                out.append(_text.mix(np.array([whole], dtype=U)))
            else:
                out.append(np.zeros(0, dtype=U))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """One value per bin for a non-empty sorted set."""
    at = np.searchsorted(hashes, _EDGES)
    stop = np.r_[at[1:], len(hashes)]
    full = np.flatnonzero(at < stop)
    sig = np.zeros(BINS, dtype=U)
    sig[full] = hashes[at[full]]
    if len(full) < BINS:
        empty = np.flatnonzero(at >= stop)
        sig[empty] = sig[full[_DONORS[empty][:, full].argmin(axis=1)]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
        for j in range(ROWS):
            h = _text.mix(h * U(0x100000001B3) + rows[:, j])
    return h.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            sets = shingle_hashes(part.column("text").to_pylist())
            prints, keys = [], []
            for s in sets:
                if not len(s):
                    prints.append(None)
                    keys.append(None)
                    continue
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(s)))
            lens = np.fromiter((0 if k is None else BANDS for k in keys), dtype=np.int32, count=len(keys))
            offsets = pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32))
            values = pa.array(np.concatenate([k for k in keys if k is not None]) if any(lens) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "mark", "n_shingles", "print", "keys"],
            )


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by star: its hub's set, then its members' sets, one at a time."""
        hub: np.ndarray | None = None
        for batch in batches:
            a, b = [], []
            for at, member, star, side in zip(range(batch.num_rows), *(batch.column(c).to_pylist() for c in ("a", "b", "side")), strict=True):
                own = np.frombuffer(batch.column("set")[at].as_buffer(), dtype=U)
                if not side:
                    hub = own.copy()
                elif linked(hub, own, percent):
                    a.append(member)
                    b.append(star)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, from products of incidence matrices."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    one, two = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(one, two)
    if not len(shared):
        return out
    sides = []
    for sets, flat in ((left, one), (right, two)):
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        keep = shared[at] == flat
        sides.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[keep], at[keep]))
    for first in range(0, len(shared), COLUMNS):
        maps = []
        for sets, (row, column) in zip((left, right), sides, strict=True):
            own = (column >= first) & (column < first + COLUMNS)
            dense = np.zeros((len(sets), min(COLUMNS, len(shared) - first)), dtype=np.float32)
            dense[row[own], column[own] - first] = 1
            maps.append(dense)
        out += maps[0] @ maps[1].T
    return out


def block_links(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between (id, label, set) of two blocks; equal labels are connected already."""
    n, m = (np.array([len(s) for _, _, s in side], dtype=np.float64) for side in (left, right))
    fit = 100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m)
    fit &= np.array([label for _, label, _ in left])[:, None] != np.array([label for _, label, _ in right])
    if not fit.any():
        return []
    rows, columns = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
    both = common([left[i][2] for i in rows], [right[j][2] for j in columns]).astype(np.float64)
    found = fit[np.ix_(rows, columns)] & (100 * both >= percent * (n[rows][:, None] + m[columns] - both))
    number: dict[int, int] = {}
    forest, out = Forest(0), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(found)), strict=True):
        a, b = left[rows[i]], right[columns[j]]
        for label in (a[1], b[1]):
            if label not in number:
                number[label] = len(forest.up)
                forest.up.append(len(forest.up))
        if forest.join(number[a[1]], number[b[1]]):
            out.append((a[0], b[0]))
    return out


def _blocks_met(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by block pair; a pair is done when the next begins."""
        key, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            links = block_links(*sides, percent) if sides[0] and sides[1] else []
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("cluster", "pair", "side", "doc_id", "label"))
            for at, (cluster, pair, side, doc, label) in enumerate(zip(*cols, strict=True)):
                if (cluster, pair) != key:
                    yield from done()
                    key, sides = (cluster, pair), ([], [])
                sides[side].append((doc, label, np.frombuffer(batch.column("set")[at].as_buffer(), dtype=U).copy()))
        yield from done()

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sets = shingle_hashes(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set"])


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as a spanning forest of (larger, smallest) rows: its members' components stay, the number of rows falls below that of nodes."""
    seen: dict[int, int] = {}
    forest = Forest(0)
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            for x in (a, b):
                if x not in seen:
                    seen[x] = len(forest.up)
                    forest.up.append(len(forest.up))
            forest.join(seen[a], seen[b])
    names = list(seen)
    least: dict[int, int] = {}
    for i, x in enumerate(names):
        r = forest.root(i)
        least[r] = min(least.get(r, x), x)
    pairs = [(x, least[forest.root(i)]) for i, x in enumerate(names) if x != least[forest.root(i)]]
    for k in range(0, len(pairs), 10_000):
        a, b = zip(*pairs[k : k + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), a written table; the root is the component's smallest node.

    Forests of `FOREST` edges each shrink the edges first. Then large-star and
    small-star steps alternate, which need O(log n) rounds for any shape and only
    joins and minima: no neighbour list is ever gathered, and rows of a node with
    very many neighbours aren't sent to its task. Each round's table is written to
    the shared folder and the one before it removed; the caller drops the last.
    """
    tasks = max(1, -(-edges.count() // FOREST))
    now = cut(edges.repartition(tasks).mapInArrow(lean(_forest_rows), "a long, b long").distinct(), "cc")
    while True:
        # done when every edge is (node, root): no root has an edge of its own, and no node two
        odd = now.select("a", F.lit(1).alias("edges"), F.lit(0).alias("hubs")).union(now.select("b", F.lit(0), F.lit(1)).distinct())
        if odd.groupBy("a").agg(F.sum("edges").alias("e"), F.max("hubs").alias("h")).where("e > 1 OR (e = 1 AND h = 1)").isEmpty():
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._quire_path = now._quire_path
            return out
        total = now.count()
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = cut(looked_up(both, least, "u", "n", 2 * total).where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "down")
        small = looked_up(large, down, "a", "n", total)
        after = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct(), "cc")
        for old in (now, least, large, down):
            drop_cut(old)
        now = after


def _fit(n, m, percent: int) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a star's member and its hub that full sets confirm. Pairs is a written table."""
    stars = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("tasks", F.ceil(F.col("n") / F.greatest(F.lit(STAR), F.sqrt("n"))).cast("int")), "stars")
    members = looked_up(pairs, stars, "b", "n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("a"), F.col("tasks")).cast("int").alias("task"))
    members = members.join(sets.hint("merge"), F.col("a") == F.col("doc_id")).select("a", "b", "task", F.lit(1).alias("side"), "set")
    hubs = stars.join(sets.hint("merge"), F.col("b") == F.col("doc_id")).select("b", F.explode(F.expr("sequence(0, tasks - 1)")).alias("task"), "set")
    met = members.unionByName(hubs.select(F.col("b").alias("a"), "b", "task", F.lit(0).alias("side"), "set"))
    out = cut(met.repartition("b", "task").sortWithinPartitions("b", "task", "side").mapInArrow(lean(_confirmed(percent)), "a long, b long"), "links")
    drop_cut(stars)
    return out


def _outsiders_met(named: DataFrame, busy: DataFrame, sets: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links (a, b) of undecided buckets: outsiders of each cluster against all of it. Tables are written ones.

    named: key, doc_id, n_shingles, label. busy: key, n, least, of buckets with several labels.
    """
    met = cut(looked_up(named, busy, "key", "n", named.count()).select("doc_id", "n_shingles", "label", "least"), "met")
    edges = cut(met.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct(), "edges")
    roots = components(edges)
    member = cut(met.select("doc_id", "n_shingles", "label").distinct().join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", "label", F.coalesce("root", "doc_id").alias("cluster")), "member")
    labels = member.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    size = F.struct("c", "label")
    load = labels.groupBy("cluster").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.max_by("label", size).alias("main"), F.max("c").alias("main_n"), F.max_by("s", size).alias("main_s"))
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / block_docs), F.ceil(s / block_shingles)).cast("int")
    load = cut(load.select("cluster", "n", "main", blocks(F.col("n"), F.col("s")).alias("blocks"), blocks(F.col("n") - F.col("main_n"), F.col("s") - F.col("main_s")).alias("outer")), "load")
    member = looked_up(member, load, "cluster", "n", member.count())
    # an outsider is also one of the members that the others meet
    number, out = F.xxhash64("doc_id"), F.col("label") != F.col("main")
    as_member = member.select("doc_id", "label", "cluster", F.lit(1).alias("side"), F.pmod(number, F.col("blocks")).alias("own"), F.explode(F.expr("sequence(0, outer - 1)")).alias("other"), "blocks")
    as_member = as_member.select("doc_id", "label", "cluster", "side", (F.col("other") * F.col("blocks") + F.col("own")).cast("long").alias("pair"))
    as_outer = member.where(out).select("doc_id", "label", "cluster", F.lit(0).alias("side"), F.pmod(number, F.col("outer")).alias("own"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"), "blocks")
    as_outer = as_outer.select("doc_id", "label", "cluster", "side", (F.col("own") * F.col("blocks") + F.col("other")).cast("long").alias("pair"))
    dealt = as_member.unionByName(as_outer).join(sets.hint("merge"), "doc_id").repartition("cluster", "pair").sortWithinPartitions("cluster", "pair")
    links = cut(dealt.select("doc_id", "label", "cluster", "pair", "side", "set").mapInArrow(lean(_blocks_met(percent)), "a long, b long"), "links")
    for old in (met, edges, roots, load):
        drop_cut(old)
    return links


def _linked_roots(reps: DataFrame, docs: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """(node, root) of all documents that link with another: stars of buckets first, then what they leave undecided."""
    keyed = reps.select(F.col("id").alias("doc_id"), "n_shingles", F.explode("keys").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    starred = cut(looked_up(keyed, buckets, "key", "n", BANDS * reps.count()).where("doc_id <> hub.doc_id"), "starred")
    pairs = cut(starred.where(_fit(F.col("n_shingles"), F.col("hub.n_shingles"), percent)).select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b")).distinct(), "pairs")
    members = starred.select(F.col("doc_id").alias("id")).union(starred.select("hub.doc_id")).distinct().join(reps.select("id", "doc_id", "mark"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").withColumn("mark", _mark())
    # of rows that share an id only those with the representative's text have its set
    texts = texts.join(members.hint("merge"), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select(F.col("id").alias("doc_id"), "text")
    sets = cut(texts.mapInArrow(lean(_with_sets), "doc_id long, set binary"), "sets")
    links = _links(pairs, sets, percent)
    roots = components(links)
    # in a bucket of two nothing is left to meet
    named = starred.where("n > 2").select("key", "doc_id", "n_shingles").join(roots, F.col("doc_id") == F.col("node"), "left")
    named = cut(named.select("key", "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("label")), "named")
    busy = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    busy = cut(busy.select("key", "n", "least"), "busy")
    if not busy.isEmpty():
        more = _outsiders_met(named, busy, sets, percent, block_docs, block_shingles)
        edges = cut(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "edges")
        drop_cut(roots)
        roots = components(edges)
        drop_cut(more)
        drop_cut(edges)
    for old in (buckets, starred, pairs, links, named, busy, sets):
        drop_cut(old)
    return roots


def _mark() -> F.Column:
    """What tells texts of one id from each other."""
    return F.coalesce(F.md5("text"), F.lit("-"))


def _judged(docs: DataFrame, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, mark, n_shingles, print, component_id of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", _mark())
    sigs = cut(own.mapInArrow(lean(_signatures), "doc_id long, mark string, n_shingles long, print binary, keys array<long>"), "sig")
    # one node for each distinct set, as one id may have several; its number is fixed once it is written
    reps = sigs.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min(F.struct("doc_id", "mark", "n_shingles", "keys")).alias("r"))
    reps = cut(reps.select("print", "r.*", F.monotonically_increasing_id().alias("id")), "rep")
    roots = _linked_roots(reps, docs, percent, block_docs, block_shingles)
    named = cut(roots.select("node", "root").union(roots.select("root", "root").distinct()).join(reps.select(F.col("id").alias("node"), "doc_id", "print"), "node"), "named")
    least = cut(named.groupBy("root").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("n")), "least")
    linked_ = cut(looked_up(named, least, "root", "n", named.count()).select("print", "component"), "linked")
    for old in (roots, named, least):
        drop_cut(old)
    groups = reps.select("print", F.col("doc_id").alias("rep")).join(linked_, "print", "left")
    out = sigs.join(groups, "print", "left")
    return out.select("doc_id", "mark", "n_shingles", "print", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Defined results: null and blank texts have no set, link with nothing and are
    kept; repeated rows with one doc_id get one result each, by their own texts;
    other columns are ignored; an empty table gives an empty table. A null id has
    no component but its own null and is kept. A text of any length is read whole,
    by one task, and two sets are compared in one task.
    """
    out = _judged(docs, percent, block_docs, block_shingles)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Defined results: of rows with one id and one set (or none) that have several
    texts, the text with the smallest md5 stays, and of rows with one id and text
    the one with the smallest hash of its columns; rows with one id and different
    sets are judged each by its own; rows without an id stay; further columns are
    kept; an empty table gives an empty table.
    """
    found = _judged(docs).where("doc_id IS NOT NULL AND component_id = doc_id")
    kept = cut(found.groupBy("doc_id", "print").agg(F.min("mark").alias("mark")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "kept")
    row, hashed = F.struct(*docs.columns), F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), _mark().alias("_mark"), hashed.alias("_hash"), row.alias("_row"))
    # one shuffle of the documents serves the join and the choice among repeated rows; planned alike at every size
    one = own.where("_id IS NOT NULL").join(kept.hint("merge"), ["_id", "_mark"], "left_semi").groupBy("_id", "_mark").agg(F.min_by("_row", "_hash").alias("_row"))
    return one.select("_row").union(own.where("_id IS NULL").select("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
