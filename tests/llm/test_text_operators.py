"""Language id, quality rules, token counts and media columns."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import _text, bpe, jpeg, langid, media, quality_rules
from tests.llm.data import documents, edge, empty, words

# language id


def test_language_of_held_out_rows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = langid.op1_language_id(spark, sf_dir)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = found.join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(both) == docs.count()
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    told = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert (told.lang == told.lang_pred).mean() > 0.95
    blank = both[both.text.map(lambda t: not any(c.isalpha() for c in t or ""))]
    assert (blank.lang_pred == "und").all() and both.score.between(0, 1).all()


def test_labels_and_ids_are_not_read_in_prediction(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.learn(docs)
    a = langid.identify(docs, model).orderBy("doc_id").collect()
    b = langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")), model).orderBy("doc_id").collect()
    assert a == b


def test_held_out_labels_dont_teach(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hidden = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in langid.learn(hidden).languages


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emit, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lens = np.array([4, 3])
    got = langid.marginals(np.where(np.arange(4)[None, :, None] < lens[:, None, None], emit, 0), lens, move)
    from itertools import product

    for c in range(2):
        want = np.zeros((lens[c], 3))
        for path in product(range(3), repeat=int(lens[c])):
            p = np.exp(sum(emit[c, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(got[c, : lens[c]], want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_code_switched_words_get_their_own_labels(spark, sf_dir):
    docs = documents(spark, sf_dir).where("lang IS NOT NULL AND text IS NOT NULL")
    model = langid.learn(docs)
    a, b = (next(r["text"] for r in docs.where(F.col("lang") == x).orderBy("doc_id").collect() if len(words(r["text"])) > 100) for x in model.languages[:2])
    text = " ".join(words(a)[20:40] + words(b)[20:40])
    labels = [y for _, _, y in langid.Labeller(model).label([text], spans=True)[0][4]]
    assert labels[:15].count(model.languages[0]) > 11 and labels[-15:].count(model.languages[1]) > 11


def test_all_letters_of_a_long_run_count(spark, sf_dir):
    docs = documents(spark, sf_dir).where("lang IS NOT NULL AND text IS NOT NULL")
    model = langid.learn(docs)
    one, other = ("".join(c for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(20).collect() for c in r["text"] if c.isalpha())[:4000] for x in model.languages[:2])
    labeller = langid.Labeller(model)
    assert labeller.label([one[:60] + other])[0][0] == model.languages[1] and labeller.label([other[:60] + one])[0][0] == model.languages[0]
    _, start, stop, first = langid.words(["ab " + "x" * 40, "y" * 101 + " z"])
    assert (stop - start).tolist() == [2, 40, 33, 34, 34, 1] and first.tolist() == [0, 2, 6]


def test_language_edges(spark):
    docs = edge(spark)
    rows = langid.identify(docs, langid.learn(docs)).collect()
    assert len(rows) == 11
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert [r["lang_pred"] for r in langid.identify(docs, None).where("doc_id = 1").collect()] == ["und"]
    assert langid.learn(empty(spark)) is None and langid.identify(empty(spark), None).count() == 0


# quality rules


def brute_rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    base = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), base


def test_measures_equal_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir).where("length(text) < 20000").collect()}
    for r in quality_rules.op6_quality_rules(spark, sf_dir).collect():
        if r["doc_id"] in texts:
            assert tuple(r)[1:7] == brute_rules(texts[r["doc_id"]]), r["doc_id"]


def test_rule_edges(spark):
    rows = quality_rules.apply_rules(edge(spark)).collect()
    assert len(rows) == 11
    for r in rows:
        assert tuple(r[c] for c in quality_rules.COLUMNS[1:7]) == brute_rules(r["text"])
    assert quality_rules.apply_rules(empty(spark)).count() == 0
    some = spark.createDataFrame([("a b a b a b a b",), ("x\n\ny\nx \nx\n",)], "text string")
    assert [brute_rules(r["text"]) for r in some.collect()] == [tuple(r[c] for c in quality_rules.COLUMNS[1:7]) for r in quality_rules.apply_rules(some).collect()]


def test_stop_words_and_words_with_letters_equal_brute_force(spark):
    odd = ["THE the tHe Él él FÜR für the. 1 22 3a \u2028 1\u2028", " \n1 2\t3 ", "\U00010400 \U0001d7d8 İ ı K", "nicht NICHT\x0bmás MÁS", "1", "a", "", None]
    rows = quality_rules.apply_rules(spark.createDataFrame([(t,) for t in odd], "text string").unionByName(edge(spark).select("text"))).collect()
    for r in rows:
        w = words(r["text"])
        assert (r["n_stop_words"], r["n_alpha_words"]) == (sum(x.lower() in quality_rules.STOP_WORDS for x in w), sum(any(c.isalpha() for c in x) for x in w))
    letters = set("".join(quality_rules.STOP_WORDS))
    assert {c for c in map(chr, range(0x110000)) if c.lower() in letters} == {x for c in letters for x in (c, c.upper())}


def test_rules_run_without_python_and_shuffle(spark, sf_dir):
    plan = quality_rules.op6_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_name_what_fails(spark):
    text = "# " * 60 + "the"
    assert "symbols" in quality_rules.apply_rules(spark.createDataFrame([(text,)], "text string")).first()["failed_rules"]


# token counts


def library_counts(texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [len(x) for x in own.encode([t or "" for t in texts], num_threads=1)]


def test_counts_equal_the_library(spark, sf_dir):
    rows = bpe.op7_token_counts(spark, sf_dir).orderBy("doc_id").collect()
    texts = [r["text"] for r in documents(spark, sf_dir).orderBy("doc_id").collect()]
    assert [r["n_tokens"] for r in rows] == library_counts(texts)
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


HARD = ["", " ", "  a  b ", "\n", "\t x", "a　b", "​", "<s> </s> <unk>", "▁▁a", "é" * 50, "😀😀", "\x00\x01", "ﬁ ﬂ", "aaaa" * 500, "数据 库", "\r\n\r\n", "x\xa0y", "<0x0A>", "﻿a"]


def test_counts_of_hard_texts():
    own = bpe.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert own.counts(HARD).tolist() == library_counts(HARD)


def test_count_edges(spark):
    rows = bpe.count_tokens(edge(spark)).collect()
    assert len(rows) == 11 and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert bpe.count_tokens(empty(spark)).count() == 0


def test_byte_ids_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [r["text"] for r in documents(spark, sf_dir).collect()] + HARD + ["it's <|endoftext|> a", "a  b   c\n\n d", "1st 2 ½ ª"]
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in bpe.byte_ids(path).encode(texts)] == want


def test_a_full_memo_forgets_and_counts_alike():
    own = bpe.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    own.memo.limit = 3
    assert own.counts(HARD).tolist() == own.counts(HARD).tolist() == library_counts(HARD)


def test_token_hashes_of_touching_tokens():
    cps = np.frombuffer("abab".encode("utf-32-le"), dtype=np.uint32)
    h = _text.token_hashes(cps, np.array([0, 2]), np.array([2, 4]))
    assert h[0] == h[1] == _text.token_hashes(cps, np.array([2]), np.array([4]))[0]


# media columns


@pytest.mark.parametrize("data", [b"", b"x", bytes(range(256)) * 9, b"\xff" * 576, b"\x00" * 577, b"\x80\x7f" * 4000, np.random.default_rng(1).integers(0, 256, 5760, dtype=np.uint8).tobytes()])
def test_media_round_trip(data):
    full = media.padded(data)
    (stored,) = media.encode([full])
    (frames,) = media.read([stored])
    assert frames.tobytes() == full and full.startswith(data) and len(full) % 576 == 0 and set(full[len(data) :]) <= {255}
    assert stored[:4] == b"RIFF" and struct.unpack("<I", stored[4:8])[0] == len(stored) - 8


def test_media_digests(spark, sf_dir):
    rows = {r["doc_id"]: r for r in media.op9_media_avi(spark, sf_dir).collect()}
    for d in documents(spark, sf_dir).collect():
        raw = (d["text"] or "").encode()
        full, r = media.padded(raw), rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-32:])


def test_shots_are_cut_where_pictures_change():
    frames = np.concatenate([np.full((10, 576), 20), np.full((10, 576), 200)]).astype(np.uint8)
    assert [c[:2] for c in media.clips(frames)] == [(0, 10), (10, 20)]


def test_media_edges(spark):
    rows = media.digests(edge(spark)).collect()
    assert len(rows) == 11
    same = [tuple(r)[1:] for r in rows if r["doc_id"] in (2, 3)]
    assert same[0] == same[1] and same[0][1] == 576
    assert media.digests(empty(spark)).count() == 0
    stored = media.store(edge(spark).where("doc_id = 5"))
    found = media.clip_rows(stored).orderBy("clip").collect()
    assert found[0]["start_ms"] == 0 and sum(r["frames"] for r in found) == len(media.read([stored.first()["media"]])[0])
    broken = spark.createDataFrame([(1, None), (2, b"RIFFxxxxAVI "), (3, b"")], "doc_id long, media binary")
    assert media.clip_rows(broken).count() == 0


class Bits:
    """Entropy-coded bytes, written bit by bit with the standard's tables."""

    def __init__(self):
        self.text = ""

    def code(self, table, symbol):
        code = at = 0
        for n in range(1, 17):
            for _ in range(table[0][n - 1]):
                if table[1][at] == symbol:
                    self.text += format(code, f"0{n}b")
                    return
                code, at = code + 1, at + 1
            code <<= 1
        raise AssertionError(symbol)

    def number(self, value):
        n = abs(value).bit_length()
        if n:
            self.text += format(value if value > 0 else value + (1 << n) - 1, f"0{n}b")

    def block(self, dc, ac, difference, rest):
        self.code(dc, abs(difference).bit_length())
        self.number(difference)
        zeros = 0
        for k, v in enumerate(rest):
            if not any(rest[k:]):
                self.code(ac, 0)
                break
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                self.code(ac, 0xF0)
                zeros -= 16
            self.code(ac, zeros << 4 | abs(v).bit_length())
            self.number(v)
            zeros = 0

    def bytes(self):
        full = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(full[k : k + 8], 2) for k in range(0, len(full), 8)).replace(b"\xff", b"\xff\x00")


def picture(rng, width, height, colour, restart, with_tables):
    """A baseline picture with random coefficients (4:2:0 in colour), and its planes by slow sums."""
    zz = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    factors = [(2, 2), (1, 1), (1, 1)] if colour else [(1, 1)]
    unit = 16 if colour else 8
    across, down = -(-width // unit), -(-height // unit)
    steps = [rng.integers(1, 9, 64).tolist() for _ in range(2)]
    tables = [(jpeg._DC_LUMA, jpeg._AC_LUMA), (jpeg._DC_CHROMA, jpeg._AC_CHROMA)]
    grids = [np.zeros((down * h * 8, across * w * 8)) for w, h in factors]
    scan, bits, last, marks = b"", Bits(), [0] * len(factors), 0
    for u in range(across * down):
        if restart and u and u % restart == 0:
            scan += bits.bytes() + bytes([0xFF, 0xD0 + marks % 8])
            bits, last, marks = Bits(), [0] * len(factors), marks + 1
        for k, (w, h) in enumerate(factors):
            for j in range(h):
                for i in range(w):
                    t = min(k, 1)
                    coefficients = [int(rng.integers(-40, 40))] + [int(x) if rng.random() < 0.2 else 0 for x in rng.integers(-12, 12, 63)]
                    if rng.random() < 0.2:
                        coefficients[1:40] = [0] * 39
                    bits.block(*tables[t], coefficients[0] - last[k], coefficients[1:])
                    last[k] = coefficients[0]
                    pixels = np.zeros((8, 8))
                    for n, (r, c) in enumerate(zz):
                        scale = (np.sqrt(0.5) if not r else 1) * (np.sqrt(0.5) if not c else 1) / 4
                        x = np.arange(8)
                        pixels += coefficients[n] * steps[t][n] * scale * np.cos((2 * x[:, None] + 1) * r * np.pi / 16) * np.cos((2 * x[None, :] + 1) * c * np.pi / 16)
                    top, left = (u // across * h + j) * 8, (u % across * w + i) * 8
                    grids[k][top : top + 8, left : left + 8] = pixels + 128
    scan += bits.bytes()
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    frame = b"\xff\xd8" + part(0xE0, b"AVI1") + part(0xDB, b"".join(bytes([k, *s]) for k, s in enumerate(steps)))
    if with_tables:
        frame += part(0xC4, b"".join(bytes([kind << 4 | t]) + tables[t][kind][0] + tables[t][kind][1] for t in (0, 1) for kind in (0, 1)))
    if restart:
        frame += part(0xDD, struct.pack(">H", restart))
    frame += part(0xC0, b"\x08" + struct.pack(">HHB", height, width, len(factors)) + b"".join(bytes([k + 1, w << 4 | h, min(k, 1)]) for k, (w, h) in enumerate(factors)))
    frame += part(0xDA, bytes([len(factors)]) + b"".join(bytes([k + 1, min(k, 1) * 17]) for k in range(len(factors))) + b"\x00\x3f\x00") + scan + b"\xff\xd9"
    full = [g if (w, h) == factors[0] else g.repeat(2, axis=0).repeat(2, axis=1) for g, (w, h) in zip(grids, factors, strict=True)]
    return frame, [np.clip(np.rint(g[:height, :width]), 0, 255) for g in full]


@pytest.mark.parametrize("width, height, colour, restart, with_tables", [(8, 8, False, 0, True), (33, 20, True, 2, False), (40, 17, True, 0, True), (21, 9, False, 1, False)])
def test_pictures_of_other_makers_are_decoded(width, height, colour, restart, with_tables):
    frame, want = picture(np.random.default_rng(width), width, height, colour, restart, with_tables)
    got = jpeg.planes(frame)
    assert len(got) == len(want) and all(np.abs(a.astype(float) - b).max() <= 1 for a, b in zip(got, want, strict=True))
    y, cb, cr = want if colour else (want[0], np.full_like(want[0], 128), np.full_like(want[0], 128))
    red = np.clip(y + 1.402 * (cr - 128), 0, 255)
    assert np.abs(jpeg.rgb(frame)[:, :, 0] - red).max() <= 3
    for cut in (10, len(frame) // 2):
        with pytest.raises((media.MediaError, struct.error, IndexError)):
            jpeg.planes(frame[:cut])


def test_the_own_frames_are_ordinary_pictures():
    samples = np.random.default_rng(4).integers(0, 256, (1, 576), dtype=np.uint8)
    (frame,) = media.encode_frames(samples)
    assert (jpeg.luma(frame) == samples.reshape(24, 24).repeat(8, axis=0).repeat(8, axis=1)).all()


def test_clips_of_other_makers_and_errors(spark):
    rng = np.random.default_rng(6)
    one, two = (picture(rng, 24, 24, True, 2, k)[0] for k in (True, False))
    movie = media.build_avi([one] * 8 + [two] * 8)
    bare = movie[: movie.index(b"idx1")]
    bare = bare[:4] + struct.pack("<I", len(bare) - 8) + bare[8:]
    rows = [(1, movie), (2, bare), (3, None), (4, b"RIFFxxxxAVI "), (5, movie[:400]), (6, media.build_avi([]))]
    found = media.clips_or_errors(spark.createDataFrame(rows, "doc_id long, media binary")).orderBy("doc_id", "clip").collect()
    assert [(r["doc_id"], r["start_ms"], r["end_ms"], r["frames"]) for r in found if r["error"] is None] == [(i, a, a + 320, 8) for i in (1, 2) for a in (0, 320)]
    assert [(r["doc_id"], r["clip"]) for r in found if r["error"]] == [(3, None), (4, None), (5, None)]


def test_broken_files_raise():
    (stored,) = media.encode([b"a" * 576])
    for bad in (b"", b"RIFF", stored[:300], stored.replace(b"idx1", b"none")):
        with pytest.raises((media.MediaError, struct.error)):
            media.read([bad])
