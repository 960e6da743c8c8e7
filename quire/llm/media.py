"""Media columns: AVI motion-JPEG.

`encode` stores a payload losslessly: 576 bytes are the 24 x 24 blocks of one
grey 192 x 192 baseline JPEG frame. A block is flat; its quantised DC
coefficient is the byte less 128 and its AC part is empty, so the entropy-coded
stream holds each byte exactly and any JPEG decoder shows it. Frames are
`00dc` chunks of a RIFF/AVI file with an `idx1` index.

`read` parses the RIFF structure and the index, then each frame's JPEG markers
and tables, and decodes all frames of a batch in step: one symbol of every
frame per array operation. Frames of other makers (textured, in colour, with
restart markers, without Huffman tables) go through `jpeg`, one at a time; files
without an index are walked chunk by chunk.

`clips` finds shots by adaptive histogram differences: a cut is where the
difference of two frames' histograms exceeds the mean of the differences around
it by a multiple of their spread. Clips are timed rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jpeg
from quire.llm._spark import lean, table
from quire.llm.jpeg import MediaError

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
MS_PER_FRAME = 40
#: Frames in one array batch: 576 steps over this many frames at once.
BATCH = 3000

# zig-zag place 0 has 8, so a flat block of value v has the DC coefficient v - 128 exactly
_DQT = b"\xff\xdb\x00\x43\x00" + bytes([8] + [1] * 63)
_SOF = b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", SIDE * 8, SIDE * 8) + b"\x01\x01\x11\x00"
# DC: nine categories with 4-bit codes; AC: end of block with the 1-bit code 0
_DHT_DC = b"\xff\xc4" + struct.pack(">H", 3 + 16 + 9) + b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
_DHT_AC = b"\xff\xc4" + struct.pack(">H", 3 + 16 + 1) + b"\x10" + bytes([1] + [0] * 15) + b"\x00"
_SOS = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
HEAD = b"\xff\xd8" + _DQT + _SOF + _DHT_DC + _DHT_AC + _SOS
TAIL = b"\xff\xd9"


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255..255: category, value, end of block."""
    codes, lens = np.zeros(511, dtype=np.uint32), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        value = d if d > 0 else d + (1 << cat) - 1
        codes[d + 255], lens[d + 255] = ((cat << cat) | (value if cat else 0)) << 1, 5 + cat
    return codes, lens


_CODES, _LENS = _code_table()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG bytes of frames given as rows of 576 samples."""
    if not len(samples):
        return []
    dc = samples.astype(np.int16) - 128
    diff = np.diff(dc, axis=1, prepend=np.int16(0)) + 255
    codes, lens = _CODES[diff], _LENS[diff]
    ends = np.cumsum(lens, axis=1)
    total = ends[:, -1]
    size = (total + 7) // 8
    first = np.r_[0, np.cumsum(size)[:-1]]
    at = (ends - lens) + first[:, None] * 8
    # a code has at most 13 bits, so with its place in a byte it touches at most three bytes
    word = (codes.astype(np.uint64) << (24 - (at & 7) - lens).astype(np.uint64)).ravel()
    byte = (at >> 3).ravel()
    n = int(size.sum())
    flat = np.zeros(n + 3)
    for k in range(3):
        flat[k : k + n + 1] += np.bincount(byte, weights=((word >> np.uint64(16 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=n + 1)[: n + 1]
    out = flat[:n].astype(np.uint8)
    spare = (size * 8 - total).astype(np.int64)
    out[first + size - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the last byte is filled with ones
    stuffed = out == 255
    where = np.r_[0, np.cumsum(1 + stuffed)]
    wide = np.zeros(int(where[-1]), dtype=np.uint8)
    wide[where[:-1]] = out
    raw, cuts = wide.tobytes(), where[np.r_[first, n]].tolist()
    return [b"".join((HEAD, raw[a:b], TAIL)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _list(kind: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", kind + data)


def build_avi(frames: list[bytes]) -> bytes:
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", MS_PER_FRAME * 1000, 0, 0, 0x10, len(frames), 0, 1, largest, SIDE * 8, SIDE * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, MS_PER_FRAME, 1000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE * 8, SIDE * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE * 8, SIDE * 8, 1, 24, b"MJPG", SIDE * SIDE * 64 * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movie = _list(b"movi", b"".join(_chunk(b"00dc", f) for f in frames))
    body = b"AVI " + header + movie + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, place of the content, size) of the chunks of a stretch; the content of lists is walked too."""
    while at + 8 <= stop:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 8, size
            at += 12
        else:
            yield kind, at + 8, size
            at += 8 + size + (size & 1)


def parse_avi(data: bytes, indexed: bool = False) -> tuple[list[bytes], int]:
    """Frames in the order of the index, or of their chunks where there is none (an error if `indexed`), and microseconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("not a RIFF AVI file")
    movie, index, micros = None, None, MS_PER_FRAME * 1000
    found: list[tuple[int, int]] = []
    for kind, at, size in _chunks(data, 12, len(data)):
        if kind == b"movi":
            movie = at if movie is None else movie
        elif kind == b"avih" and size >= 4:
            micros = struct.unpack_from("<I", data, at)[0]
        elif kind == b"idx1":
            index = data[at : at + size]
        elif movie is not None and kind[2:] in (b"dc", b"db"):
            found.append((at, size))
    if movie is None:
        raise MediaError("no movie")
    if index is None:
        if indexed:
            raise MediaError("no index")
        if any(at + size > len(data) for at, size in found):
            raise MediaError("a chunk that is cut off")
        return [data[at : at + size] for at, size in found], micros
    frames = []
    for kind, _, offset, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if kind[2:] not in (b"dc", b"db"):
            continue
        # offsets count from the movie's list or, in some files, from the file's start
        p = movie + offset if data[movie + offset : movie + offset + 4] == kind else offset
        if data[p : p + 4] != kind or struct.unpack_from("<I", data, p + 4)[0] != size:
            raise MediaError("the index doesn't point at a chunk")
        frames.append(data[p + 8 : p + 8 + size])
    return frames, micros


@dataclass(frozen=True)
class Tables:
    """What a frame's markers say; start: of its entropy-coded bytes."""

    height: int
    width: int
    dc_step: int
    dc: tuple[np.ndarray, np.ndarray]
    end_code: int
    end_bits: int
    start: int


def _huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(bits, code, symbol) of a table in its canonical order."""
    out, code, k = [], 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            out.append((bits, code, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.lru_cache(64)
def _parsed(head: bytes) -> Tables:
    at, dc, end, steps, height, width = 2, None, None, 1, 0, 0
    while True:
        if head[at] != 0xFF:
            raise MediaError("no marker where one must be")
        kind, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if kind == 0xDB:
            if body[0] >> 4:
                raise MediaError("16-bit quantisation")
            steps = body[1]
        elif kind == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            if body[0] != 8 or body[5] != 1:
                raise MediaError("only grey frames of 8 bits")
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes = _huffman(body[1:17], body[17 : 17 + n])
                if body[0] >> 4:
                    end = next((c for c in codes if c[2] == 0), None)
                else:
                    cat, bits = np.full(1 << 16, 255, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
                    for b, code, symbol in codes:
                        cat[code << (16 - b) : (code + 1) << (16 - b)] = symbol
                        bits[code << (16 - b) : (code + 1) << (16 - b)] = b
                    dc = (cat, bits)
                body = body[17 + n :]
        elif kind == 0xDA:
            if dc is None or end is None or not height:
                raise MediaError("a scan without its tables")
            return Tables(height, width, steps, dc, end[1], end[0], at + 2 + size)
        at += 2 + size


def tables(frame: bytes) -> Tables:
    if frame[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    if frame.startswith(HEAD):
        return _parsed(HEAD)
    at = frame.find(b"\xff\xda")
    if at < 0:
        raise MediaError("no scan")
    return _parsed(frame[: at + 2 + struct.unpack_from(">H", frame, at + 2)[0]])


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (one per block) of frames of one size and set of tables, decoded in step."""
    if not frames:
        return np.zeros((0, FRAME), dtype=np.uint8)
    if len(frames) > BATCH:
        return np.concatenate([decode_frames(frames[k : k + BATCH]) for k in range(0, len(frames), BATCH)])
    own = [tables(f) for f in frames]
    t = own[0]
    if any(o is not t for o in own):
        return np.concatenate([decode_frames([f]) for f in frames])
    blocks = ((t.height + 7) // 8) * ((t.width + 7) // 8)
    scans = [f[t.start : -2] if f.endswith(TAIL) else f[t.start :] for f in frames]
    lens = np.fromiter(map(len, scans), dtype=np.int64, count=len(scans))
    flat = np.frombuffer(b"".join(scans), dtype=np.uint8)
    first = np.r_[0, np.cumsum(lens)]
    # a zero after 255 was stuffed in
    stuffed = np.zeros(len(flat), dtype=bool)
    stuffed[1:] = (flat[:-1] == 255) & (flat[1:] == 0)
    stuffed[first[:-1][lens > 0]] = False
    kept = np.r_[0, np.cumsum(~stuffed)]
    bits = np.concatenate([flat[~stuffed], np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    # 32 bits from each byte on
    wide = (bits[:-3] << np.uint32(24)) | (bits[1:-2] << np.uint32(16)) | (bits[2:-1] << np.uint32(8)) | bits[3:]
    at = kept[first[:-1]] * 8
    stop = kept[first[1:]] * 8
    out = np.zeros((len(frames), blocks), dtype=np.uint8)
    last = np.zeros(len(frames), dtype=np.int64)
    cats, code_bits = t.dc[0], t.dc[1]
    shift = np.uint32(32 - t.end_bits)
    limit = len(wide) - 1
    for k in range(blocks):
        w = wide[np.minimum(at >> 3, limit)] << (at & 7).astype(np.uint32)
        top = w >> np.uint32(16)
        cat, used = cats[top].astype(np.int64), code_bits[top].astype(np.int64)
        if (cat > 11).any():
            raise MediaError("a code that isn't in the table")
        # 25 bits are sure in w: at most 16 of the code; the value is read anew
        at = at + used
        w = wide[np.minimum(at >> 3, limit)] << (at & 7).astype(np.uint32)
        value = (w.astype(np.uint64) >> (32 - cat).astype(np.uint64)).astype(np.int64)
        half = np.where(cat > 0, np.int64(1) << np.maximum(cat - 1, 0), 0)
        last = last + np.where(value < half, value - (half << 1) + 1, value) * (cat > 0)
        at = at + cat
        w = wide[np.minimum(at >> 3, limit)] << (at & 7).astype(np.uint32)
        if (w >> shift != t.end_code).any():
            raise MediaError("a block that isn't flat")
        at = at + t.end_bits
        out[:, k] = np.clip(last * t.dc_step // 8 + 128, 0, 255)
    if (at > stop).any():
        raise MediaError("a frame ends too early")
    return out


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // FRAME)) * FRAME
    return data + PAD * (n - len(data))


def encode(payloads: list[bytes]) -> list[bytes]:
    """One AVI file for each payload, which is a positive multiple of 576 bytes."""
    counts = [len(p) // FRAME for p in payloads]
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME)
    frames = [f for k in range(0, len(samples), BATCH) for f in encode_frames(samples[k : k + BATCH])]
    out, at = [], 0
    for n in counts:
        out.append(build_avi(frames[at : at + n]))
        at += n
    return out


def read(files: list[bytes]) -> list[np.ndarray]:
    """Each file's frames as rows of samples."""
    parsed = [parse_avi(f, indexed=True)[0] for f in files]  # what store() writes has one
    samples = decode_frames([f for frames in parsed for f in frames])
    out, at = [], 0
    for frames in parsed:
        out.append(samples[at : at + len(frames)])
        at += len(frames)
    return out


def histograms(samples: np.ndarray, bins: int = 16) -> np.ndarray:
    n = len(samples)
    place = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * bins
    return np.bincount(place.ravel(), minlength=n * bins).reshape(n, bins)


def clips(samples: np.ndarray, window: int = 5, factor: float = 2.0, least: int = 58) -> list[tuple[int, int, int]]:
    """(first frame, end, largest difference) of each shot of frames given as rows of samples."""
    return shots(histograms(samples), window, factor, least) if len(samples) else []


def shots(hist: np.ndarray, window: int = 5, factor: float = 2.0, least: int = 58) -> list[tuple[int, int, int]]:
    """(first frame, end, largest difference) of each shot; the threshold follows the differences around it."""
    n = len(hist)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    cuts = [0]
    if len(diff):
        total, square = np.r_[0, np.cumsum(diff)], np.r_[0, np.cumsum(diff * diff)]
        i = np.arange(len(diff))
        low, high = np.maximum(i - window, 0), np.minimum(i + window + 1, len(diff))
        others = high - low - 1
        mean = np.where(others > 0, (total[high] - total[low] - diff) / np.maximum(others, 1), 0.0)
        spread = np.sqrt(np.maximum(0, np.where(others > 0, (square[high] - square[low] - diff * diff) / np.maximum(others, 1), 0.0) - mean * mean))
        cuts += (np.flatnonzero(diff > np.maximum(mean + factor * spread, least)) + 1).tolist()
    ends = [*cuts[1:], n]
    return [(a, b, int(diff[a : b - 1].max()) if b - a > 1 else 0) for a, b in zip(cuts, ends, strict=True)]


def _batches(rows: list[bytes]) -> Iterator[tuple[int, int]]:
    at, frames = 0, 0
    for i, r in enumerate(rows):
        k = len(r) // FRAME
        if i > at and frames + k > BATCH:
            yield at, i
            at, frames = i, 0
        frames += k
    if at < len(rows):
        yield at, len(rows)


def clips_of(data: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """A file's shots and its microseconds per frame; differences are of histograms of 576 samples, whatever the size of the pictures."""
    frames, micros = parse_avi(data)
    if all(f.startswith(HEAD) for f in frames):
        return clips(decode_frames(frames)), micros
    hist = []
    for f in frames:
        light = jpeg.luma(f)
        hist.append(np.rint(histograms(light.reshape(1, -1))[0] * (FRAME / light.size)).astype(np.int64))
    return shots(np.array(hist)), micros


def clips_or_errors(media: DataFrame) -> DataFrame:
    """media(doc_id, media) -> timed clips (doc_id, clip, start_ms, end_ms, frames, motion, error).

    Defined results: a file that can't be read is one row that says why, with null
    for the rest; so is a null file; a file without frames has no clips; repeated
    rows give their clips again; other columns are ignored; a file is decoded by
    one task, a frame at a time; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "clip", "start_ms", "end_ms", "frames", "motion", "error"]
        for batch in batches:
            rows: list[tuple] = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    if data is None:
                        raise MediaError("no file")
                    found, micros = clips_of(data)
                except (MediaError, struct.error, IndexError) as e:
                    rows.append((doc, None, None, None, None, None, str(e) or type(e).__name__))
                    continue
                rows += [(doc, k, a * micros // 1000, b * micros // 1000, b - a, motion, None) for k, (a, b, motion) in enumerate(found)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(lean(run), "doc_id long, clip int, start_ms long, end_ms long, frames long, motion long, error string")


def clip_rows(media: DataFrame) -> DataFrame:
    """The clips of the files that can be read (see clips_or_errors for the others)."""
    return clips_or_errors(media).where("error IS NULL").drop("error")


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, media): the text's bytes as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [padded((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            for a, b in _batches(data):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(encode(data[a:b]), pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, media binary")


_SPEC = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> checksums of what was stored and read back, and the shots as a string.

    Defined results: null and empty texts are one frame of padding; repeated rows
    and equal texts give equal values; other columns are ignored; a text of any
    length is stored whole by one task; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            data = [padded(r) for r in raw]
            docs_ = batch.column("doc_id").to_pylist()
            for a, b in _batches(data):
                files = encode(data[a:b])
                cols: list[list] = [[] for _ in range(8)]
                for doc, r, f, samples in zip(docs_[a:b], raw[a:b], files, read(files), strict=True):
                    payload = samples.tobytes()
                    shots = clips(samples)
                    feature = f"{len(samples)} frames, {len(shots)} shots: " + ",".join(f"{x * MS_PER_FRAME}-{y * MS_PER_FRAME}/{m}" for x, y, m in shots)
                    row = (doc, len(r), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _SPEC.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _SPEC)


def op9_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
