"""The decoder is held against an independent encoder that uses every feature of the format."""

import random
import struct
import zlib

import numpy as np
import pytest

from lodewell.llm import _vp8l, webp


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, code):
        self.bits += [int(c) for c in code]

    def data(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b[i + j] << j for j in range(8)) for i in range(0, len(b), 8))


def lengths_for(symbols):
    """A complete code of unequal lengths: 1, 2, 3, ... for a few symbols, balanced for the rest."""
    s = sorted(symbols)
    if len(s) == 1:
        return {s[0]: 1}
    out, depth = {}, 0
    while len(s) > 2 and depth < 4:
        depth += 1
        out[s.pop(len(s) // 2)] = depth
    n = (len(s) - 1).bit_length()
    short = (1 << n) - len(s)
    for i, x in enumerate(s):
        out[x] = depth + (n - 1 if i < short else n)
    return out


def codes_for(lengths):
    if len(lengths) == 1:
        return {next(iter(lengths)): ""}
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s] = format(code, f"0{n}b")
        code, last = code + 1, n
    return out


def put_prefix(o, symbols, alphabet, r):
    symbols = sorted(symbols) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256 and r.random() < 0.7:
        o.put(1, 1)
        o.put(len(symbols) - 1, 1)
        small = symbols[0] < 2 and r.random() < 0.5
        o.put(0 if small else 1, 1)
        o.put(symbols[0], 1 if small else 8)
        if len(symbols) == 2:
            o.put(symbols[1], 8)
        return codes_for({s: 1 for s in symbols})
    lengths = lengths_for(symbols)
    ops, i, last = [], 0, 8
    while i < alphabet:
        n = lengths.get(i, 0)
        run = 1
        while i + run < alphabet and lengths.get(i + run, 0) == n:
            run += 1
        if n == 0 and run >= 11:
            run = min(run, 138)
            ops.append((18, run - 11, 7))
        elif n == 0 and run >= 3:
            run = min(run, 10)
            ops.append((17, run - 3, 3))
        elif n and n == last and run >= 3:
            run = min(run, 6)
            ops.append((16, run - 3, 2))
        else:
            run = 1
            ops.append((n, 0, 0))
            last = n or last
        i += run
    if r.random() < 0.5:  # the trailing zeros may be left out
        while ops and ops[-1][0] in (0, 17, 18):
            ops.pop()
        limit = len(ops)
    else:
        limit = None
    if limit is not None and limit < 2:
        ops.append((18, 0, 7))
        limit = len(ops)
        if limit < 2:
            ops.append((0, 0, 0))
            limit = 2
    own = lengths_for({x[0] for x in ops})
    o.put(0, 1)
    used = max(webp.LENGTH_ORDER.index(s) for s in own) + 1
    used = max(4, used)
    o.put(used - 4, 4)
    for s in webp.LENGTH_ORDER[:used]:
        o.put(own.get(s, 0), 3)
    code = codes_for(own)
    if limit is None:
        o.put(0, 1)
    else:
        o.put(1, 1)
        nbits = max(2, (limit - 2).bit_length())
        nbits += nbits % 2
        o.put((nbits - 2) // 2, 3)
        o.put(limit - 2, nbits)
    for s, extra, n in ops:
        o.code(code[s])
        o.put(extra, n)
    return codes_for(lengths)


def value_code(v):
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << (top - 1)) - 1), top - 1


def put_image(o, px, width, r, main, cache_bits=0, meta=False):
    n, height = len(px), len(px) // width
    o.put(1 if cache_bits else 0, 1)
    if cache_bits:
        o.put(cache_bits, 4)
    shift, groups = 0, 1
    which = lambda i: 0
    if main:
        o.put(1 if meta else 0, 1)
        if meta:
            shift, groups = 2, 3
            side = (width + 3) >> 2
            of = [r.randrange(groups) for _ in range(side * ((height + 3) >> 2))]
            of[0] = groups - 1
            o.put(0, 3)
            put_image(o, [g << 8 | 0xFF000000 for g in of], side, r, False)
            which = lambda i: of[(i // width >> shift) * side + (i % width >> shift)]
    ops, i, cache = [], 0, {}
    at = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    short = {}
    for k, (x, y) in enumerate(webp.PLANE):
        short.setdefault(max(1, x + y * width), k + 1)
    while i < n:
        best = (0, 0)
        for d in {1, 2, 3, width, width - 1, width + 1, 2 * width, 37, 150}:
            if 0 < d <= i:
                m = 0
                while i + m < n and m < 300 and px[i + m] == px[i + m - d]:
                    m += 1
                best = max(best, (m, d))
        if best[0] >= 2 and r.random() < 0.8:
            m, d = best
            v = short[d] if d in short and r.random() < 0.7 else d + 120
            (lc, le, ln), (dc, de, dn) = value_code(m), value_code(v)
            ops.append((which(i), "ref", lc, le, ln, dc, de, dn))
            step = m
        elif cache_bits and cache.get(at(px[i]), 0) == px[i]:
            ops.append((which(i), "cache", at(px[i])))
            step = 1
        else:
            ops.append((which(i), "lit", px[i]))
            step = 1
        for j in range(i, i + step):
            if cache_bits:
                cache[at(px[j])] = px[j]
        i += step
    use = [[set() for _ in range(5)] for _ in range(groups)]
    for g, kind, *v in ops:
        u = use[g]
        if kind == "lit":
            for k, s in enumerate((8, 16, 0, 24)):
                u[k].add(v[0] >> s & 255)
        elif kind == "ref":
            u[0].add(256 + v[0])
            u[4].add(v[3])
        else:
            u[0].add(280 + v[0])
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    codes = [[put_prefix(o, u[k], sizes[k], r) for k in range(5)] for u in use]
    for g, kind, *v in ops:
        c = codes[g]
        if kind == "lit":
            for k, s in enumerate((8, 16, 0, 24)):
                o.code(c[k][v[0] >> s & 255])
        elif kind == "ref":
            o.code(c[0][256 + v[0]])
            o.put(v[1], v[2])
            o.code(c[4][v[3]])
            o.put(v[4], v[5])
        else:
            o.code(c[0][280 + v[0]])


def pack(p):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in p.reshape(-1, 4)]


def i8(x):
    return (int(x) & 255 ^ 128) - 128


def guess(mode, lt, t, tr, tl):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode == 11:
        p = [x + y - z for x, y, z in zip(lt, t, tl, strict=True)]
        pl = sum(abs(a - b) for a, b in zip(p, lt, strict=True))
        pt = sum(abs(a - b) for a, b in zip(p, t, strict=True))
        return lt if pl < pt else t
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(lt, t, tl, strict=True)]
    if mode == 13:
        return [clamp(a + int((a - b) / 2)) for a, b in zip(avg(lt, t), tl, strict=True)]
    return [None, lt, t, tr, tl, avg(avg(lt, tr), t), avg(lt, tl), avg(lt, t), avg(tl, t), avg(t, tr), avg(avg(lt, tl), avg(t, tr))][mode]


def forward_predictor(img, bits, modes):
    h, w, _ = img.shape
    src = [[list(map(int, p)) for p in row] for row in img]
    flat = [p for row in src for p in row]
    out = img.copy()
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = [0, 0, 0, 255] if x == 0 else src[0][x - 1]
            elif x == 0:
                p = src[y - 1][0]
            else:
                p = guess(int(modes[y >> bits][x >> bits]), src[y][x - 1], src[y - 1][x], flat[(y - 1) * w + x + 1], src[y - 1][x - 1])
            out[y, x] = [(a - b) & 255 for a, b in zip(src[y][x], p, strict=True)]
    return out


def encode(img, r, kinds, cache_bits=0, meta=False):
    h, w, _ = img.shape
    o = Out()
    o.put(w - 1, 14)
    o.put(h - 1, 14)
    o.put(1, 1)
    o.put(0, 3)
    for kind in kinds:
        o.put(1, 1)
        o.put(kind, 2)
        bits = r.choice([2, 3])
        bw, bh = (w + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits
        if kind == 0:
            modes = [[r.randrange(14) for _ in range(bw)] for _ in range(bh)]
            o.put(bits - 2, 3)
            put_image(o, [0xFF000000 | m << 8 for row in modes for m in row], bw, r, False, r.choice([0, 2]))
            img = forward_predictor(img, bits, modes)
        elif kind == 1:
            f = [[[r.randrange(256) for _ in range(3)] for _ in range(bw)] for _ in range(bh)]
            o.put(bits - 2, 3)
            put_image(o, [0xFF000000 | a << 16 | b << 8 | c for row in f for a, b, c in row], bw, r, False)
            out = img.copy()
            for y in range(h):
                for x in range(w):
                    rb, gb, gr = (i8(v) for v in f[y >> bits][x >> bits])
                    red, green, blue, _ = (int(v) for v in img[y, x])
                    out[y, x, 0] = (red - (gr * i8(green) >> 5)) & 255
                    out[y, x, 2] = (blue - (gb * i8(green) >> 5) - (rb * i8(red) >> 5)) & 255
            img = out
        elif kind == 2:
            img = img.copy()
            img[..., 0] -= img[..., 1]
            img[..., 2] -= img[..., 1]
        else:
            table = np.unique(img.reshape(-1, 4), axis=0)
            r2 = table[np.random.default_rng(1).permutation(len(table))]
            n = len(r2)
            o.put(n - 1, 8)
            put_image(o, pack(np.diff(np.concatenate([np.zeros((1, 4), np.uint8), r2]), axis=0).astype(np.uint8)), n, r, False)
            index = {tuple(p): i for i, p in enumerate(r2.tolist())}
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            pw = (w + (1 << packed) - 1) >> packed
            out = np.zeros((h, pw, 4), np.uint8)
            out[..., 3] = 255
            for y in range(h):
                for x in range(w):
                    out[y, x >> packed, 1] |= index[tuple(img[y, x].tolist())] << (x & ((1 << packed) - 1)) * (8 >> packed)
            img, w = out, pw
    o.put(0, 1)
    put_image(o, pack(img), w, r, True, cache_bits, meta)
    data = b"\x2f" + o.data()
    return b"RIFF" + struct.pack("<I", 12 + len(data) + (len(data) & 1)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


@pytest.mark.parametrize("seed", range(40))
def test_every_feature(seed):
    r, g = random.Random(seed), np.random.default_rng(seed)
    h, w = r.randint(1, 20), r.randint(1, 23)
    colours = g.integers(0, 256, (r.choice([1, 2, 3, 4, 13, 60, 200]), 4), dtype=np.uint8)
    img = colours[g.integers(0, len(colours), (h, w))]
    if seed % 3 == 0:
        img[h // 2 :] = img[: h - h // 2]  # something to refer back to
    kinds = r.sample([0, 1, 2], r.randint(0, 3))
    if len(colours) < 256 and seed % 2:
        kinds = [3, *(k for k in kinds if k == 0)]
    data = encode(img, r, kinds, r.choice([0, 1, 4, 11]), seed % 4 == 1)
    assert (webp.decode(data) == img).all(), kinds
    plain = encode(img, r, [], r.choice([0, 1, 4, 11]), False)
    for got in webp.decode_all([data, webp.encode(img), plain, data]):
        assert (got == img).all(), kinds


def test_lockstep_reads_foreign_streams():
    """Streams of the independent encoder without transforms and groups: most are read in lockstep, and give the same as one by one."""
    files = []
    for seed in range(60):
        r, g = random.Random(seed), np.random.default_rng(seed)
        colours = g.integers(0, 256, (r.choice([1, 2, 3, 13, 60]), 4), dtype=np.uint8)
        img = colours[g.integers(0, len(colours), (r.randint(1, 12), r.randint(1, 23)))]
        img[len(img) // 2 :] = img[: len(img) - len(img) // 2]
        files.append(encode(img, r, [], r.choice([0, 1, 4, 11]), False))
    found = _vp8l.decode([webp._stream(f) for f in files])
    assert sum(x is not None for x in found) >= 50
    for f, got, x in zip(files, webp.decode_all(files), found, strict=True):
        assert (webp.decode(f) == got).all() and (x is None or x[1:] == got.shape[1::-1])


def test_what_the_encoder_writes():
    """On texts: codes of unequal lengths everywhere, copies and cached pixels in their share, and fewer bytes than with literals alone."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    told, total, stored = {}, 0, 0
    for t in texts:
        raw = (t or "").encode()
        raw += b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        images = webp._cut(raw, 144)
        files = webp.encode_all(images, told)
        assert all((webp.decode(f) == i).all() for f, i in zip(files, images, strict=True))
        total, stored = total + len(raw), stored + sum(map(len, files))
    share = {k: told[k] / told["frames"] for k in ("frames_with_cache", "frames_with_copies")} | {k: told[k] * 4 / total for k in ("literals", "cached", "copied")}
    print(share, stored / total)
    assert share["frames_with_copies"] > 0.8 and share["frames_with_cache"] > 0.3 and share["cached"] > 0.02 and share["copied"] > 0.05 and stored < 0.6 * total


@pytest.mark.parametrize("used", [1, 2, 3, 7, 100, 344])
def test_code_lengths(used):
    g = np.random.default_rng(used)
    counts = np.zeros((50, 344), np.int64)
    for row in counts:
        row[g.choice(344, used, False)] = np.maximum(1, g.pareto(0.7, used)).clip(0, 50_000).astype(np.int64)
    size = _vp8l.code_lengths(counts).astype(int)
    assert ((size > 0) == (counts > 0)).all() and size.max() <= _vp8l.LIMIT
    if used > 1:
        assert (np.where(size > 0, 2.0 ** -size, 0).sum(1) == 1).all()


def test_plane_is_the_format_s():
    assert len(webp.PLANE) == 120 and webp.PLANE[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.PLANE[-1] == (8, 7)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 60, 64, 65, 129, 256])
def test_round_trip(n):
    g = np.random.default_rng(n)
    img = g.integers(0, n, (7, 144, 4)).astype(np.uint8)[..., :]
    assert (webp.decode(webp.encode(img)) == img).all()
    tall = g.integers(0, n, (webp.MAX_SIDE + 3, 2, 4)).astype(np.uint8)
    media = webp.store(tall.tobytes(), 2)
    assert b"".join(i.tobytes() for i in webp.frames(media)) == tall.tobytes()


def test_broken():
    good = webp.encode(np.arange(576, dtype=np.int64).astype(np.uint8).reshape(1, 144, 4))
    for bad in (b"", good[:11], good[:60], b"RIFF" + good[4:8] + b"WEBX" + good[12:]):
        for read in (webp.decode, lambda x: webp.decode_all([good, x])):
            with pytest.raises((ValueError, struct.error)):
                read(bad)


def test_query(spark, docs_of, tmp_path):
    import hashlib

    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "long " * 3000, "a", "\udcff".encode("utf-8", "replace").decode()]
    docs_of(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in webp.op6_webp_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[2][1:] == got[7][1:] and got[2].media_bytes < 576
    media = webp.decode_column(webp.encode_column(docs_of([(1, "abc"), (2, None)])))
    assert {r.id: bytes(r.frames[0].pixels)[:4] for r in media.collect()} == {1: b"abc\xff", 2: b"\xff" * 4}
    assert webp.encode_column(docs_of([])).count() == 0
    same = [r for r in webp.encode_column(docs_of([(1, "again " * 50_000), (1, "again " * 50_000), (None, "again " * 50_000)])).collect()]
    assert len({bytes(r.media) for r in same}) == 1 and b"".join(i.tobytes() for i in webp.frames(same[0].media)).rstrip(b"\xff") == b"again " * 50_000
