"""Quality classifier by co-training on two views.

The text view sees hashed words and shape ratios of the whole text; the
metadata view sees source, language and length. Each is a logistic model. In
every round each view scores all documents that have no label and labels those
that it is surest of, in the classes' proportion, for the other view. Both are
then calibrated on a fold that neither learned from, and a logistic model over
the calibrated views scores all documents.

Fitting sees a bounded sample of labelled documents, at most `LABELLED`, chosen
by hash, and no label of the held-out third; a round adds at most `PER_ROUND`
documents to a view. Only their features come to the driver. All features are
written once; rounds read them, and each task keeps its surest documents alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _text
from quire.llm._spark import cut, drop_cut, lean, table
from quire.llm.langid import held_out

WORDS = 1 << 14
SHAPES = 12
META = 1 << 11
LABELLED = 2400
ROUNDS, PER_ROUND = 3, 120
KEEP_FROM = 0.5


def text_view(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each text: unit-length word counts, then shape ratios."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in _text.groups(texts):
        cps, off = _text.codes(texts[a:b])
        low = np.where((cps >= 65) & (cps <= 90), cps + np.uint32(32), cps)
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[off] = True
        start = np.flatnonzero(word & (~np.r_[False, word[:-1]] | edge[:-1])) if len(low) else np.zeros(0, dtype=np.int64)
        stop = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:])) + 1 if len(low) else np.zeros(0, dtype=np.int64)
        h = _text.token_hashes(low, start, stop)
        first = np.searchsorted(start, off)
        ascii_ = low < 128
        letter = ((low >= 97) & (low <= 122)) | ~ascii_
        digit = (low >= 48) & (low <= 57)
        line = low == 10
        sums = [_text.segment_sums(x.astype(np.int64), off) for x in (word, letter, digit, word & ascii_ & ~letter & ~digit, (cps >= 65) & (cps <= 90), line)]
        for i in range(b - a):
            own = h[first[i] : first[i + 1]]
            n = max(1, len(own))
            solid, letters, digits, symbols, upper, lines = (float(s[i]) for s in sums)
            bins, counts = np.unique((own & np.uint64(WORDS - 1)).astype(np.int64), return_counts=True)
            value = np.sqrt(counts)
            distinct = len(np.unique(own))
            pairs = len(np.unique(own[:-1] * np.uint64(31) + own[1:])) if len(own) > 1 else 1
            shape = np.array([1.0, np.log1p(len(own)) / 8, solid / n / 8, letters / max(1, solid), digits / max(1, solid), symbols / max(1, solid), upper / n, distinct / n, pairs / max(1, n - 1), lines / n, float(len(own) < 50), float(symbols > 0.1 * solid)])
            out.append((np.r_[bins, WORDS + np.arange(SHAPES)], np.r_[value / max(1e-9, np.sqrt((value * value).sum())) if len(value) else value, shape]))
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    size = -1 if n_chars is None else int(n_chars).bit_length()
    names = [f"s{source}", f"l{lang}", f"n{size}", f"l{lang}n{size}", f"s{source}n{size}", "b"]
    numbers = np.unique([zlib.crc32(x.encode("utf-8", "surrogatepass")) % META for x in names])
    return numbers, np.ones(len(numbers))


@dataclass
class View:
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([float(self.weights[i] @ v) for i, v in rows])

    def calibrated(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.scale * self.logits(rows) + self.shift


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, steps: int = 120, decay: float = 3e-4) -> np.ndarray:
    """Logistic weights by Adam; classes weigh alike."""
    lens = np.fromiter((len(i) for i, _ in rows), dtype=np.int64, count=len(rows))
    flat, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    owner, at = np.repeat(np.arange(len(rows)), lens), np.cumsum(lens) - lens
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        p = sigmoid(np.add.reduceat(w[flat] * value, at))
        g = np.bincount(flat, weights=((p - y) * share)[owner] * value, minlength=size) + decay * w
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        w -= 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make logits probabilities of the given rows (smoothed targets, Newton steps)."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        r, w = p - target, p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray  # of the calibrated logits, and a constant

    def score(self, text_rows: list, meta_rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zt, zm = self.text.calibrated(text_rows), self.meta.calibrated(meta_rows)
        return sigmoid(self.mix[0] * zt + self.mix[1] * zm + self.mix[2]), sigmoid(zt), sigmoid(zm)


Row = tuple[np.ndarray, np.ndarray]
#: Finds, for fitted weights of both views, the surest documents of each: (view, label, id, text row, metadata row), surest first.
Surest = Callable[[list[np.ndarray], list[set], int, int], list[tuple[int, int, int, Row, Row]]]


def co_train(rows: dict[int, tuple[Row, Row]], labels: dict[int, int], surest: Surest, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model | None:
    """Labelled rows learn, or calibrate if they are of fold 0; surest() is asked for those without label."""
    learn = [i for i in sorted(labels) if i in rows and _fold(i)]
    check = [i for i in sorted(labels) if i in rows and not _fold(i)]
    if len({labels[i] for i in learn}) < 2:
        return None
    if len({labels[i] for i in check}) < 2:
        check = learn
    rows = dict(rows)
    own: list[dict[int, int]] = [{i: labels[i] for i in learn}, {i: labels[i] for i in learn}]
    sizes = (WORDS + SHAPES, META)
    good = sum(labels[i] for i in learn) / len(learn)
    fitted = [np.zeros(0), np.zeros(0)]
    for turn in range(rounds + 1):
        for v in (0, 1):
            items = sorted(own[v].items())
            fitted[v] = fit([rows[i][v] for i, _ in items], np.array([y for _, y in items], dtype=float), sizes[v])
        if turn == rounds:
            break
        up, down = max(1, round(per_round * good)), max(1, round(per_round * (1 - good)))
        for v, y, i, text, meta in surest(fitted, [set(own[1]) | set(labels), set(own[0]) | set(labels)], up, down):
            rows.setdefault(i, (text, meta))
            own[1 - v].setdefault(i, y)
    y = np.array([labels[i] for i in check], dtype=float)
    done = []
    for v in (0, 1):
        view = View(fitted[v])
        view.scale, view.shift = platt(view.logits([rows[i][v] for i in check]), y)
        done.append(view)
    z = np.stack([done[v].calibrated([rows[i][v] for i in check]) for v in (0, 1)] + [np.ones(len(check))], axis=1)
    mix = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = sigmoid(z @ mix)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(3) * 0.5, z.T @ (p - y) + 0.5 * (mix - np.array([1.0, 0.0, 0.0])))
        mix = mix - np.clip(step, -1, 1)
    return Model(done[0], done[1], mix)


def _drawn(i: int) -> int:
    return zlib.crc32(f"fold{i}".encode())


def _fold(i: int) -> int:
    return _drawn(i) % 4


_SAMPLE = "doc_id long, ti array<int>, tv array<float>, mi array<int>"
_SAMPLE_KINDS = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32()))


def _with_views(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata columns; those that docs hasn't are null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *((F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            meta = [meta_view(*x) for x in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            text = text_view(part.column("text").to_pylist())
            cols = [part.column("doc_id").to_pylist(), [x[0] for x in text], [x[1] for x in text], [x[0] for x in meta]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SAMPLE_KINDS, strict=True)], names=["doc_id", "ti", "tv", "mi"])


def _sums(weights: np.ndarray, index: pa.Array, value: pa.Array | None) -> np.ndarray:
    """Logits of rows of feature lists, of which none is empty."""
    flat = weights[index.flatten().to_numpy(zero_copy_only=False)]
    if value is not None:
        flat = flat * value.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False))
    return np.add.reduceat(flat, np.r_[0, ends[:-1]])


def _surest_of(weights: list[np.ndarray], known: list[set], up: int, down: int):
    """Each task's surest documents by view and label; ties, of which the metadata view has many, are drawn by a hash of the id."""
    names = ["view", "label", "z", "tie", "doc_id", "ti", "tv", "mi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple]] = {(v, y): [] for v in (0, 1) for y in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            ties = np.fromiter(map(_drawn, docs.tolist()), dtype=np.int64, count=len(docs))
            scores = (_sums(weights[0], batch.column("ti"), batch.column("tv")), _sums(weights[1], batch.column("mi"), None))
            for (v, y), kept in best.items():
                z, most = (scores[v], up) if y else (-scores[v], down)
                for k in np.lexsort((docs, ties, -z)).tolist():
                    if z[k] <= 1 or len(kept) >= most and (-z[k], ties[k], docs[k]) > kept[most - 1][:3]:
                        break
                    if int(docs[k]) not in known[v]:
                        kept.append((-float(z[k]), int(ties[k]), int(docs[k]), *(batch.column(c)[k].as_py() for c in ("ti", "tv", "mi"))))
                kept.sort(key=lambda x: x[:3])
                # rows of one id are alike to the next round
                seen: set[int] = set()
                kept[:] = [x for x in kept if not (x[2] in seen or seen.add(x[2]))][:most]
        rows = [(v, y, *x) for (v, y), kept in best.items() for x in kept]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.int64(), *_SAMPLE_KINDS), strict=True)], names=names)

    return run


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model | None:
    """Fit on labels(doc_id, quality) of documents outside the held-out third, and on what the views tell each other of all others."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("co")), F.lit(1 << 40))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen: dict[int, int] = {}
    for r in usable.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", place.alias("place")).orderBy("place", "doc_id", "quality").limit(labelled).collect():
        chosen.setdefault(r["doc_id"], int(r["quality"]))
    if len(set(chosen.values())) < 2:
        return None
    rows = cut(_with_views(docs.where(F.col("doc_id").isNotNull())).mapInArrow(lean(_views), _SAMPLE), "views")

    def row_of(r) -> tuple[Row, Row]:
        meta = np.array(r["mi"], dtype=np.int64)
        return (np.array(r["ti"], dtype=np.int64), np.array(r["tv"])), (meta, np.ones(len(meta)))

    def surest(weights: list[np.ndarray], known: list[set], up: int, down: int) -> list[tuple[int, int, int, Row, Row]]:
        found = cut(rows.mapInArrow(lean(_surest_of(weights, known, up, down)), "view int, label int, z double, tie long, " + _SAMPLE), "surest")
        out = []
        for v in (0, 1):
            for y, most in ((1, up), (0, down)):
                # one id may come from several tasks
                for r in found.where((F.col("view") == v) & (F.col("label") == y)).groupBy("doc_id").agg(F.min(F.struct("z", "tie", "ti", "tv", "mi")).alias("r")).select("doc_id", "r.*").orderBy("z", "tie", "doc_id").limit(most).collect():
                    out.append((v, y, r["doc_id"], *row_of(r)))
        drop_cut(found)
        return out

    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long"))  # at most `labelled` rows
    known: dict[int, tuple[Row, Row]] = {}
    for r in rows.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("ti", "tv", "mi")).alias("r")).select("doc_id", "r.*").collect():
        known[r["doc_id"]] = row_of(r)
    model = co_train(known, chosen, surest, rounds, per_round)
    drop_cut(rows)
    return model


def score(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs(doc_id, text, source, lang, n_chars) -> doc_id, score, text_score, meta_score, kept.

    Defined results: null and blank texts score 0 and aren't kept; without labels
    of both classes there is no model and all other documents score 1; repeated
    rows are scored one by one; source, lang or n_chars that aren't there are null;
    other columns are ignored; a text of any length is read whole; an empty table
    gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                texts = part.column("text").to_pylist()
                blank = np.array([not t or not t.strip() for t in texts])
                if model:
                    meta = [meta_view(*x) for x in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
                    found = model.score(text_view(texts), meta)
                else:
                    found = (np.ones(len(texts)),) * 3
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.where(blank, 0.0, f)) for f in found)], names=["doc_id", "score", "text_score", "meta_score"])

    return _with_views(docs).mapInArrow(lean(run), "doc_id long, score double, text_score double, meta_score double").withColumn("kept", F.col("score") >= keep_from)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "text_score", "meta_score", "kept")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept; scored and filtered in one pass over their own rows.

    The model is op10's, of the whole table: docs may have lost all labels of a class.
    Defined results: null and blank texts go; without labels of both classes all
    others stay; source, lang or n_chars that docs hasn't are null; repeated rows
    and further columns stay; an empty table gives an empty table.
    """
    model = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if model is None:
        return docs.where(F.length(F.trim("text")) > 0)
    at = {c: docs.columns.index(c) for c in ("text", "source", "lang", "n_chars") if c in docs.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                texts = part.column(at["text"]).to_pylist()
                meta = [meta_view(*x) for x in zip(*(part.column(at[c]).to_pylist() if c in at else [None] * len(texts) for c in ("source", "lang", "n_chars")), strict=True)]
                blank = np.array([not t or not t.strip() for t in texts], dtype=bool)
                yield part.filter(pa.array((model.score(text_view(texts), meta)[0] >= KEEP_FROM) & ~blank))

    return docs.mapInArrow(lean(run), docs.schema)
