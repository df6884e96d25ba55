"""Lossless WebP: a decoder of the whole format, and an encoder.

A stream is read by prefix codes (simple and normal, one group or an image of groups), back-references
with their two-dimensional distances, and the colour cache; the predictor, cross-colour,
subtract-green and palette transforms are inverted. decode() reads one file symbol by symbol,
decode_all() many: those without transforms and groups in lockstep (_vp8l), the others one by one.
encode_all() writes prefix codes of each frame's own, back-references, and the cache where it
is of use; it writes no transform, since none makes bytes of text fewer. Pixels are arrays of
height x width x 4 bytes, in the order red, green, blue, alpha.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lexical import spread
from . import _vp8l
from ._common import Scratch, frugal, no_null
from ._vp8l import CACHE_HASH, LENGTH_ORDER, PLANE, riff

MAX_SIDE = 1 << 14
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
SAMPLES = 576
#: Rows of a stored frame (a long text has several frames), and bytes of pixels that are encoded or decoded at once.
FRAME_ROWS, AT_ONCE = 14, 1 << 22


class Bits:
    """Reads a byte string from the lowest bit up; past its end there are zeros, once asked for more than those it fails."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)


def _reverse(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


class Prefix:
    """A canonical prefix code by its symbols' lengths."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths
        self.only = next(iter(lengths)) if len(lengths) == 1 else None
        self._table: list[tuple[int, int]] | None = None
        if not lengths or self.only is None and sum(1 << (15 - n) for n in lengths.values()) != 1 << 15:
            raise ValueError("a prefix code must be complete")

    def table(self) -> list[tuple[int, int]]:
        if self._table is None:
            self.top = max(self.lengths.values())
            table, code, last = [(0, 0)] * (1 << self.top), 0, 0
            for symbol, n in sorted(self.lengths.items(), key=lambda x: (x[1], x[0])):
                code <<= n - last
                for i in range(_reverse(code, n), 1 << self.top, 1 << n):
                    table[i] = (symbol, n)
                code, last = code + 1, n
            self._table = table
        return self._table

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        table = self.table()
        symbol, n = table[bits.peek(self.top)]
        bits.read(n)
        return symbol


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths = {first: 1, bits.read(8): 1} if two else {first: 1}
        return Prefix(lengths)
    own = {}
    for symbol in LENGTH_ORDER[: 4 + bits.read(4)]:
        if n := bits.read(3):
            own[symbol] = n
    code, left = Prefix(own), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    lengths, symbol, last = {}, 0, 8
    while symbol < alphabet and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            if n:
                lengths[symbol] = last = n
            symbol += 1
        elif n == 16:
            for _ in range(3 + bits.read(2)):
                lengths[symbol] = last
                symbol += 1
        else:
            symbol += 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
    if symbol > alphabet:
        raise ValueError("code lengths run over")
    return Prefix(lengths)


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as packed pixels, alpha highest."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups_at, shift, count = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        side = (width + (1 << shift) - 1) >> shift
        of = read_image(bits, side, (height + (1 << shift) - 1) >> shift, False)
        groups_at = (of >> 8 & 0xFFFF).reshape(-1, side)
        count = int(groups_at.max()) + 1
    sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    groups = [[read_prefix(bits, n) for n in sizes] for _ in range(count)]
    n = width * height
    out, i = [0] * n, 0
    cache = [0] * (1 << cache_bits) if cache_bits else None
    fresh = 0  # pixels that are in the cache
    group = groups[0]
    while i < n:
        if groups_at is not None:
            group = groups[int(groups_at[i // width >> shift, i % width >> shift])]
        s = group[GREEN].read(bits)
        if s < 256:
            red, blue, alpha = (group[c].read(bits) for c in (RED, BLUE, ALPHA))
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            length = _value(s - 256, bits)
            d = _value(group[DISTANCE].read(bits), bits)
            if d > 120:
                d -= 120
            else:
                x, y = PLANE[d - 1]
                d = max(1, x + y * width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for j in range(i, i + length):
                out[j] = out[j - d]
            i += length
        else:
            while fresh < i:
                cache[(CACHE_HASH * out[fresh] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[fresh]
                fresh += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.uint32)


def _planes(argb: np.ndarray) -> np.ndarray:
    """Packed pixels as red, green, blue, alpha."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0, 24)], axis=-1).astype(np.int32)


def _predict(mode: int, left, top, right, corner):
    """The prediction of a pixel, or of a row of them, from its neighbours (arrays whose last axis is the channels)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 6:
        return left + corner >> 1
    if mode == 7:
        return left + top >> 1
    if mode == 8:
        return corner + top >> 1
    if mode == 9:
        return top + right >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        change = mean - corner
        return np.clip(mean + np.where(change < 0, -(-change >> 1), change >> 1), 0, 255)
    return np.array([0, 0, 0, 255])  # mode 0, and the two that are not in use


#: Modes that don't look at the pixel to the left: a whole stretch of a row at once.
_NO_LEFT = {0, 2, 3, 4, 8, 9, 14, 15}


def undo_predictor(img: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """img: residuals, height x width x 4."""
    img = img.astype(np.int32)
    height, width, _ = img.shape
    img[0, 0] += [0, 0, 0, 255]
    img[0] = np.cumsum(img[0], axis=0) & 255
    for y in range(1, height):
        row, above = img[y], img[y - 1]
        row[0] = (row[0] + above[0]) & 255
        x = 1
        while x < width:
            mode, end = int(modes[y >> bits, x >> bits]) & 15, min(width, ((x >> bits) + 1) << bits)
            if mode in _NO_LEFT:
                right = np.concatenate([above[x + 1 : end + 1], row[:1]])[: end - x] if end == width else above[x + 1 : end + 1]
                row[x:end] = (row[x:end] + _predict(mode, None, above[x:end], right, above[x - 1 : end - 1])) & 255
            else:
                for i in range(x, end):
                    row[i] = (row[i] + _predict(mode, row[i - 1], above[i], above[i + 1] if i + 1 < width else row[0], above[i - 1])) & 255
            x = end
    return img


def undo_cross_colour(img: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    """factors: red_to_blue, green_to_blue and green_to_red in red, green and blue of each block."""
    height, width, _ = img.shape
    signed = lambda a: (a & 255 ^ 128) - 128
    f = signed(np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[:height, :width])
    red, green, blue = img[..., 0], img[..., 1], img[..., 2]
    red = (red + (f[..., 2] * signed(green) >> 5)) & 255
    blue = (blue + (f[..., 1] * signed(green) >> 5) + (f[..., 0] * signed(red) >> 5)) & 255
    return np.stack([red, green, blue, img[..., 3]], -1)


def undo_palette(img: np.ndarray, table: np.ndarray, width: int, packed: int) -> np.ndarray:
    """Indices in green, 1 << packed of them in a pixel, lowest bits first; past the table is transparent black."""
    size = 8 >> packed
    steps = np.arange(1 << packed) * size
    index = (img[..., 1][..., None] >> steps & ((1 << size) - 1)).reshape(img.shape[0], -1)[:, :width]
    return np.concatenate([table, np.zeros((256, 4), table.dtype)])[index]


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels of a VP8L bit stream."""
    if data[:1] != b"\x2f":
        raise ValueError("not a lossless stream")
    bits = Bits(data[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, full, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            b = bits.read(3) + 2
            w = (width + (1 << b) - 1) >> b
            of = _planes(read_image(bits, w, (height + (1 << b) - 1) >> b, False)).reshape(-1, w, 4)
            undo.append((lambda img, of=of[..., 1], b=b: undo_predictor(img, of, b)) if kind == 0 else (lambda img, of=of, b=b: undo_cross_colour(img, of, b)))
        elif kind == 2:
            undo.append(lambda img: np.stack([(img[..., 0] + img[..., 1]) & 255, img[..., 1], (img[..., 2] + img[..., 1]) & 255, img[..., 3]], -1))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_planes(read_image(bits, n, 1, False)), axis=0) & 255
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda img, table=table, w=width, p=packed: undo_palette(img, table, w, p))
            width = (width + (1 << packed) - 1) >> packed
    argb = read_image(bits, width, height, True)
    if not undo:
        return argb.astype("<u4").view(np.uint8).reshape(height, full, 4)[..., [2, 1, 0, 3]]
    img = _planes(argb).reshape(height, width, 4)
    for f in reversed(undo):
        img = f(img)
    return img.astype(np.uint8)


def _stream(data: bytes) -> bytes:
    """The lossless bit stream of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= min(end, len(data)):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with a lossless image."""
    return decode_stream(_stream(data))


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each of many files."""
    streams = [_stream(f) for f in files]
    out = []
    for stream, got in zip(streams, _vp8l.decode(streams) if streams else [], strict=True):
        if got is None:
            out.append(decode_stream(stream))
        else:
            argb, width, height = got
            out.append(argb.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]])
    return out


def encode_all(images: list[np.ndarray], told: dict[str, int] | None = None) -> list[bytes]:
    """A WebP file of each of many images (height x width x 4 bytes). told: gets the sums of _vp8l.encode()'s counts."""
    if not images:
        return []
    for x in images:
        if not (0 < x.shape[0] <= MAX_SIDE and 0 < x.shape[1] <= MAX_SIDE):
            raise ValueError("sides must be 1 to 16384")
    flat = np.concatenate([x.reshape(-1, 4)[:, [2, 1, 0, 3]] for x in images])
    streams, counts = _vp8l.encode(np.ascontiguousarray(flat).view("<u4").ravel().astype(np.uint32), np.array([x.shape[1] for x in images]), np.array([x.shape[0] for x in images]))
    if told is not None:
        for k, n in counts.items():
            told[k] = told.get(k, 0) + n
    return [riff(s) for s in streams]


def encode(pixels: np.ndarray) -> bytes:
    return encode_all([pixels])[0]


def _cut(payload: bytes, width: int) -> list[np.ndarray]:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width, 4)
    return [rows[at : at + FRAME_ROWS] for at in range(0, len(rows), FRAME_ROWS)]


def store(payload: bytes, width: int = SAMPLES // 4) -> bytes:
    """Bytes (a multiple of four times width) as WebP files on end, of FRAME_ROWS rows each."""
    return b"".join(encode_all(_cut(payload, width)))


def _files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + size])
        at += size
    return out


def frames(media: bytes) -> list[np.ndarray]:
    """The pixels of each WebP file of a byte string."""
    return decode_all(_files(media))


def _in_parts(values: list[list], size, run) -> list[list]:
    """run() over the items of all values together, AT_ONCE bytes at a time, and its results by value."""
    flat, out, at, bytes_ = [x for v in values for x in v], [], 0, 0
    for i, x in enumerate(flat):
        bytes_ += size(x)
        if bytes_ >= AT_ONCE:
            out += run(flat[at : i + 1])
            at, bytes_ = i + 1, 0
    out += run(flat[at:])
    done = iter(out)
    return [[next(done) for _ in v] for v in values]


def feature(images: list[np.ndarray]) -> str:
    """Channel means and a 64-bit mean hash of the green channel's blocks, over all frames."""
    flat = np.concatenate([i.reshape(-1, 4) for i in images])
    means = flat.mean(axis=0, dtype=np.float64)
    cells = np.add.reduceat(flat[:, 1].astype(np.int64), np.arange(64) * len(flat) // 64) / np.diff(np.r_[np.arange(64) * len(flat) // 64, len(flat)])
    return ",".join(f"{m:.3f}" for m in means) + f":{int.from_bytes(np.packbits(cells > means[1]).tobytes(), 'big'):016x}"


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", multiple: int = SAMPLES) -> DataFrame:
    """(id, n_bytes, media): each text's bytes, filled up with 255 to a positive multiple, as lossless WebP.

    A null text is empty; a very long one has several frames. Ids may be null and rows repeated;
    no other column of docs is looked at, whatever its name. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.as_py().encode() for t in b.column(1)]
            cut = [_cut(t + b"\xff" * (-len(t) % multiple or multiple * (not t)), multiple // 4) for t in raw]
            media = [b"".join(x) for x in _in_parts(cut, lambda x: x.nbytes, encode_all)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text")).mapInArrow(frugal(run, 2048), f"id {kind}, n_bytes long, media binary")


def decode_column(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's rows with frames: array<struct<width int, height int, pixels binary>>, pixels in rows of red, green, blue, alpha. Null media have null frames; broken media are an error; a column named frames is replaced."""

    @F.pandas_udf("array<struct<width: int, height: int, pixels: binary>>")
    def read(col):
        import pandas as pd

        shown = lambda x: {"width": x.shape[1], "height": x.shape[0], "pixels": x.tobytes()}
        found = _in_parts([[] if m is None else _files(m) for m in col], lambda x: 2 * len(x), decode_all)
        return pd.Series([None if m is None else [shown(f) for f in x] for m, x in zip(col, found, strict=True)])

    return media.withColumn("frames", read(media_col))


def op6_webp_media(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    stored = Scratch(spark, "media").save(encode_column(docs), "webp", "none")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            media = b.column(2).to_pylist()
            for m, images in zip(media, _in_parts([_files(m) for m in media], lambda x: 2 * len(x), decode_all), strict=True):
                payload = b"".join(i.tobytes() for i in images)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(images)))
            cols = zip(*out, strict=True) if out else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(frugal(digest, 2048), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
