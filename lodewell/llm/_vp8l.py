"""Lossless image bit streams, many at once: every step is an array operation over all frames of a batch.

Writing: copies of four or more pixels (the last earlier place with the same four pixels), pixels
from the colour cache where a frame has enough of them, literals for the rest, each frame with
prefix codes of its own. Reading: frames are decoded in lockstep, a symbol of each frame in a
step. Streams with transforms, several code groups or codes of over TOP bits are for the
decoder of single streams.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

_U32, _U64 = np.uint32, np.uint64
#: Fixed by the format: the order in which lengths of the code for code lengths are stored, and the hash of the colour cache.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_HASH = 0x1E35A7BD
#: Short distances: offsets in the plane, the nearest first, of equals the highest row, then from the left.
PLANE = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
#: Codes that are written have LIMIT bits at most, those read in lockstep TOP.
LIMIT, TOP = 11, 12
#: Pixels of a copy at least and at most; bits of a cache, and the pixels that must be found in it for a frame to have one.
COPY, COPY_MOST, CACHE_BITS, CACHE_LEAST = 4, 4096, 6, 24
GREEN = 256 + 24


def _reversal(n: int) -> np.ndarray:
    x, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
    for i in range(n):
        out |= (x >> i & 1) << (n - 1 - i)
    return out


_REVERSED = {n: _reversal(n) for n in range(TOP + 1)}


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts; a row with a single symbol has length 1 there."""
    counts = counts.astype(np.int64)
    total = counts.sum(1, keepdims=True)
    room = (1 << limit) - counts.shape[1]
    counts = np.where((counts > 0) & (total > room), np.maximum(1, counts * room // np.maximum(total, 1)), counts)
    total = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        size = np.ceil(np.log2(np.maximum(total, 1)) - np.log2(counts) - 1e-9)
    size = np.where(counts > 0, np.clip(size, 1, limit), 0).astype(np.int64)
    slack = (1 << limit) - np.where(size > 0, 1 << (limit - size), 0).sum(1)
    several = (size > 0).sum(1) > 1
    while (left := np.flatnonzero(several & (slack > 0))).size:  # what is left over shortens codes, short ones first
        own, free = size[left], slack[left]
        for n in range(1, limit):
            step = limit - n - 1
            here = own == n + 1
            take = np.minimum(here.sum(1), free >> step)
            if take.any():
                own -= here & (np.cumsum(here, 1) <= take[:, None])
                free = free - (take << step)
        size[left], slack[left] = own, free
    return size.astype(np.uint8)


def codes(size: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The codes of canonical lengths, bits in the order of the stream."""
    f, s = np.nonzero(size)
    n = size[f, s].astype(np.int64)
    order = np.argsort(f * 16 + n, kind="stable")
    f, s, n = f[order], s[order], n[order]
    width = 1 << (limit - n)
    upto = np.cumsum(width) - width
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, int)
    upto -= np.repeat(upto[first], np.diff(np.r_[first, len(f)]))
    out = np.zeros(size.shape, np.int64)
    out[f, s] = _REVERSED[limit][upto & ((1 << limit) - 1)]
    return out


def _static() -> tuple[np.ndarray, np.ndarray]:
    """A code for code lengths that suits letters: its lengths and codes."""
    often = {0: 6, 1: 1, 2: 1, 3: 3, 4: 8, 5: 14, 6: 20, 7: 22, 8: 22, 9: 18, 10: 14, 11: 10, 17: 10, 18: 8}
    heap = [(n, s, [s]) for s, n in often.items()]
    heapq.heapify(heap)
    size = np.zeros((1, 19), np.uint8)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        size[0, a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    return size[0].astype(np.int64), codes(size, 7)[0]


_SIZE_BITS, _SIZE_CODE = _static()
_HEAD = sum(int(_SIZE_BITS[s]) << (5 + 3 * i) for i, s in enumerate(LENGTH_ORDER)) | (len(LENGTH_ORDER) - 4) << 1  # 62 bits, and the flag that all lengths follow


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and extra bits of lengths and distance codes."""
    x = value - 1
    top = np.where(x > 0, np.int64(np.log2(np.maximum(x, 1))), 0)
    extra = np.maximum(top - 1, 0)
    symbol = np.where(x < 2, x, 2 * top + (x >> extra & 1))
    return symbol, np.where(x < 4, 0, extra), np.where(x < 4, 0, x & ((1 << extra) - 1))


class _Segments:
    """Values of some bits each, in parts that follow one another in every frame."""

    def __init__(self, frames: int):
        self.frames, self.parts = frames, []

    def put(self, frame: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """frame is in order; values have 32 bits at most."""
        self.parts.append((frame, value, bits))

    def data(self) -> list[bytes]:
        size = np.stack([np.bincount(f, bits, self.frames) for f, _, bits in self.parts], 1).astype(np.int64)
        own = size.sum(1)
        start = np.cumsum((own + 31) // 32) - (own + 31) // 32
        at = start[:, None] * 32 + np.cumsum(size, 1) - size
        n = int(((own + 31) // 32).sum()) + 2
        words = np.zeros(n)
        for k, (f, value, bits) in enumerate(self.parts):
            upto = np.cumsum(bits) - bits
            before = np.zeros(self.frames, np.int64)
            first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, int)
            before[f[first]] = upto[first]
            pos = at[f, k] + upto - before[f]
            v = value.astype(_U64) << (pos & 31).astype(_U64)
            word = pos >> 5
            words += np.bincount(word, (v & _U64(0xFFFFFFFF)).astype(float), n) + np.bincount(word + 1, (v >> _U64(32)).astype(float), n)  # bits don't overlap, so sums are exact
        raw = words.astype(_U32).tobytes()
        return [raw[4 * s : 4 * s + (b + 7) // 8] for s, b in zip(start.tolist(), own.tolist(), strict=True)]


def _copies(argb: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where copies begin, how many pixels they have and how far back they come from."""
    if len(argb) < COPY:
        return (np.zeros(0, np.int64),) * 3
    a, m = argb.astype(_U64), len(argb) - COPY + 1
    key = frame[:m].astype(_U64)
    for i in range(COPY):
        key = (key ^ a[i : i + m]) * _U64(0x9E3779B97F4A7C15)
        key ^= key >> _U64(29)
    inside = np.flatnonzero(frame[:m] == frame[COPY - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    i, j = order[1:][same], order[:-1][same]
    for k in range(COPY):
        if len(i):
            keep = (argb[i + k] == argb[j + k]) & (frame[i] == frame[j])
            i, j = i[keep], j[keep]
    back = np.zeros(len(argb) + 1, np.int64)
    back[i] = i - j
    change = back[1:] != back[:-1]
    starts = np.flatnonzero((back[:-1] > 0) & np.r_[True, change[:-1]])
    ends = np.flatnonzero((back[:-1] > 0) & change) + 1
    out, cover = [], 0
    for s, e, d in zip(starts.tolist(), ends.tolist(), back[starts].tolist(), strict=True):
        e += COPY - 1
        s = max(s, cover)
        while e - s >= COPY:
            n = min(e - s, COPY_MOST)
            out.append((s, n, d))
            s += n
        cover = max(cover, s) if out and out[-1][0] + out[-1][1] == s else cover
    at = np.array(out, np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2]


def _put_code(out: _Segments, size: np.ndarray, alphabet: np.ndarray) -> None:
    """A prefix code for each frame: simple for a single symbol, else by its lengths."""
    single = (size > 0).sum(1) < 2
    only = np.flatnonzero(single)
    symbol = size[only].argmax(1).astype(np.int64)
    out.put(only, np.where(symbol < 2, 1 | symbol << 3, 5 | symbol << 3), np.where(symbol < 2, 4, 11))
    own = np.flatnonzero(~single)
    out.put(own, np.full(len(own), _HEAD & 0x7FFFFFFF), np.full(len(own), 31))
    out.put(own, np.full(len(own), _HEAD >> 31), np.full(len(own), 32))
    there = np.arange(size.shape[1]) < alphabet[own][:, None]
    flat, row = size[own][there].astype(np.int64), np.repeat(own, alphabet[own])
    if not len(flat):
        return
    zero = flat == 0
    begin = np.flatnonzero(np.r_[True, ~(zero[1:] & zero[:-1] & (row[1:] == row[:-1]))])
    run, blank = np.diff(np.r_[begin, len(flat)]), zero[begin]
    whole, rest = np.where(blank, run // 138, 0), np.where(blank, run % 138, 1)
    many = whole + np.where(blank & (rest >= 3), 1, rest)
    of = np.repeat(np.arange(len(begin)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    full, rest = k < whole[of], rest[of]
    long, mid = blank[of] & (full | (rest >= 11)), blank[of] & ~full & (rest >= 3) & (rest < 11)
    symbol = np.where(long, 18, np.where(mid, 17, flat[begin][of]))
    extra = np.where(full, 127, np.where(long, rest - 11, np.where(mid, rest - 3, 0)))
    out.put(row[begin][of], _SIZE_CODE[symbol] | extra << _SIZE_BITS[symbol], _SIZE_BITS[symbol] + np.where(long, 7, np.where(mid, 3, 0)))


def encode(argb: np.ndarray, widths: np.ndarray, heights: np.ndarray) -> tuple[list[bytes], dict[str, int]]:
    """Bit streams of frames whose packed pixels lie on end, and how many literals, cached pixels and copies were written."""
    sizes = widths * heights
    frames, frame = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    start, length, back = _copies(argb, frame)
    edge = np.zeros(len(argb) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    free = np.cumsum(edge[:-1]) == 0
    place = (argb * _U32(CACHE_HASH)) >> _U32(32 - CACHE_BITS)
    slot = (frame << CACHE_BITS) | place
    order = np.argsort(slot, kind="stable")
    found = np.zeros(len(argb), bool)
    found[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    found &= free
    cached = np.bincount(frame[found], minlength=frames) >= CACHE_LEAST
    found &= cached[frame]

    byte = lambda n: (argb >> _U32(n) & _U32(255)).astype(np.int64)
    symbol = np.where(found, GREEN + place.astype(np.int64), byte(8))
    long, long_bits, long_extra = _prefix(length)
    symbol[start] = 256 + long
    token = free.copy()
    token[start] = True
    pos, literal = np.flatnonzero(token), np.flatnonzero(free & ~found)
    near = {}  # plane codes by distance, for each width
    for w in set(widths.tolist()):
        near[w] = {}
        for i, (x, y) in enumerate(PLANE):
            near[w].setdefault(max(1, x + y * w), i + 1)
    far = np.array([near[w].get(d, d + 120) for w, d in zip(widths[frame[start]].tolist(), back.tolist(), strict=True)], np.int64)
    far, far_bits, far_extra = _prefix(far)

    def code(of: np.ndarray, value: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
        size = code_lengths(np.bincount(of * alphabet + value, minlength=frames * alphabet).reshape(frames, alphabet))
        return size, codes(size)

    out, zero = _Segments(frames), np.zeros(frames, np.int64)
    every = np.arange(frames)
    out.put(every, 0x2F | (widths - 1) << 8, zero + 22)
    out.put(every, (heights - 1) | 1 << 14, zero + 18)
    out.put(every, np.where(cached, 1 << 1 | CACHE_BITS << 2, 0), np.where(cached, 7, 3))  # no transform, the cache, one group
    green = code(frame[pos], symbol[pos], GREEN + (1 << CACHE_BITS))
    others = [code(frame[literal], byte(n)[literal], 256) for n in (16, 0, 24)]
    distance = code(frame[start], far, 40)
    for (size, _), alphabet in zip([green, *others, distance], [np.where(cached, GREEN + (1 << CACHE_BITS), GREEN), zero + 256, zero + 256, zero + 256, zero + 40], strict=True):
        _put_code(out, size, alphabet)

    def written(c: tuple[np.ndarray, np.ndarray], of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and their lengths; a single symbol has no bits."""
        one = ((c[0] > 0).sum(1) < 2)[of]
        return np.where(one, 0, c[1][of, value]), np.where(one, 0, c[0][of, value].astype(np.int64))

    value, bits = np.zeros((len(argb), 2), np.int64), np.zeros((len(argb), 2), np.int64)
    value[pos, 0], bits[pos, 0] = written(green, frame[pos], symbol[pos])
    (red, red_bits), (blue, blue_bits), (alpha, alpha_bits) = (written(c, frame[literal], byte(n)[literal]) for c, n in zip(others, (16, 0, 24), strict=True))
    value[literal, 0] |= red << bits[literal, 0]
    bits[literal, 0] += red_bits
    value[literal, 1], bits[literal, 1] = blue | alpha << blue_bits, blue_bits + alpha_bits
    value[start, 0] |= long_extra << bits[start, 0]
    bits[start, 0] += long_bits
    far, own = written(distance, frame[start], far)
    value[start, 1], bits[start, 1] = far | far_extra << own, own + far_bits
    out.put(np.repeat(frame[pos], 2), value[pos].ravel(), bits[pos].ravel())
    return out.data(), {"frames": frames, "literals": len(literal), "cached": int(found.sum()), "copies": len(start), "copied": int(length.sum()), "frames_with_cache": int(cached.sum()), "frames_with_copies": len(np.unique(frame[start]))}


def riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


# reading


def _tables(size: np.ndarray, top: int) -> np.ndarray:
    """For each row of complete codes' lengths, symbol << 4 | length by the next `top` bits. A single symbol takes no bits."""
    f, s = np.nonzero(size)
    n = size[f, s].astype(np.int64)
    n = np.where((size > 0).sum(1)[f] == 1, 0, n)
    order = np.argsort(f * 16 + n, kind="stable")
    f, s, n = f[order], s[order], n[order]
    return np.repeat((s << 4 | n).astype(np.uint16), 1 << (top - n)).reshape(-1, 1 << top)[:, _REVERSED[top]]


def _complete(size: np.ndarray, top: int) -> np.ndarray:
    n = (size > 0).sum(1)
    full = np.where(size > 0, 1 << np.maximum(top - size.astype(np.int64), 0), 0).sum(1) == 1 << top
    return (n == 1) | (n > 1) & full & (size.max(1) <= top)


class _Reader:
    def __init__(self, streams: list[bytes]):
        self.raw = b"".join(x for s in streams for x in (s, bytes(16)))
        self.view = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        sizes = np.array([len(s) for s in streams], np.int64)
        start = np.cumsum(sizes + 16) - sizes - 16
        self.pos, self.end = start * 8, (start + sizes) * 8

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n bits (57 at most) at bit positions; past the end of the last stream they are those before it."""
        byte = np.minimum(at >> 3, len(self.view) - 1)
        return (self.view[byte] >> (at & 7).astype(_U64) & ((_U64(1) << np.asarray(n, _U64)) - _U64(1))).astype(np.int64)

    def read(self, which: np.ndarray, n) -> np.ndarray:
        out = self.peek(self.pos[which], n)
        self.pos[which] += n
        return out

    def lengths(self, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths of the frames' next prefix codes, and which of them can be read on in lockstep."""
        frames = len(alphabet)
        every, size, good = np.arange(frames), np.zeros((frames, int(alphabet.max(initial=1))), np.uint8), np.ones(frames, bool)
        simple = self.read(every, 1) == 1
        if len(f := np.flatnonzero(simple)):
            two, wide = self.read(f, 1), self.read(f, 1)
            symbol = self.read(f, np.where(wide == 1, 8, 1))
            good[f] &= symbol < alphabet[f]
            size[f, np.minimum(symbol, alphabet[f] - 1)] = 1
            if len(g := f[two == 1]):
                symbol = self.read(g, 8)
                good[g] &= symbol < alphabet[g]
                size[g, np.minimum(symbol, alphabet[g] - 1)] = 1
        f = np.flatnonzero(~simple)
        if not len(f):
            return size, good
        n, own = 4 + self.read(f, 4), np.zeros((len(f), 19), np.uint8)
        for i, s in enumerate(LENGTH_ORDER):
            here = np.flatnonzero(i < n)
            own[here, s] = self.read(f[here], 3)
        whole = _complete(own, 7)
        good[f[~whole]] = False
        f, own = f[whole], own[whole]
        if not len(f):
            return size, good
        table, left = _tables(own, 7).ravel().astype(np.int64), alphabet[f].copy()
        some = self.read(f, 1) == 1
        bits = 2 + 2 * self.read(f[some], 3)
        left[some] = 2 + self.read(f[some], bits)
        now, last, base = np.zeros(len(f), np.int64), np.full(len(f), 8), np.arange(len(f)) << 7
        act = np.arange(len(f))
        while len(act):
            at = f[act]
            e = table[base[act] + self.peek(self.pos[at], 7)]
            self.pos[at] += e & 15
            s = e >> 4
            plain = s < 16
            p = act[plain]
            size[f[p], now[p]] = s[plain]
            last[p] = np.where(s[plain] > 0, s[plain], last[p])
            step = np.ones(len(act), np.int64)
            if not plain.all():
                q = ~plain
                step[q] = np.where(s[q] == 18, 11, 3) + self.read(at[q], np.select([s[q] == 16, s[q] == 17], [2, 3], 7))
                again = act[s == 16]
                for k in range(6):
                    on = again[(k < step[s == 16]) & (now[again] + k < alphabet[f[again]])]
                    size[f[on], now[on] + k] = last[on]
            now[act] += step
            left[act] -= 1
            over = now[act] > alphabet[at]
            good[at[over]] = False
            act = act[(now[act] < alphabet[at]) & (left[act] > 0)]
        return size, good


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, int, int] | None]:
    """Packed pixels, width and height of each stream, None for those that can't be read in lockstep."""
    out: list = [None] * len(streams)
    r = _Reader(streams)
    every = np.arange(len(streams))
    fine = r.read(every, 8) == 0x2F
    width, height = r.read(every, 14) + 1, r.read(every, 14) + 1
    r.read(every, 1)
    fine &= (r.read(every, 3) == 0) & (r.read(every, 1) == 0)
    has = r.read(every, 1) == 1
    cache_bits = np.where(has, r.peek(r.pos, 4), 0)
    r.pos[has] += 4
    fine &= (cache_bits <= 11) & (has == (cache_bits > 0)) & (r.read(every, 1) == 0)
    own = every[fine]
    if not len(own):
        return out
    r.pos, r.end, width, height, cache_bits = r.pos[own], r.end[own], width[own], height[own], cache_bits[own]
    sizes, good = [], np.ones(len(own), bool)
    for alphabet in (GREEN + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(len(own), 256)] * 3, np.full(len(own), 40)):
        size, ok = r.lengths(alphabet)
        good &= ok & _complete(size, TOP)
        sizes.append(size)
    keep = np.flatnonzero(good & (r.pos <= r.end))
    if not len(keep):
        return out
    own, pos, end, width, height, cache_bits = own[keep], r.pos[keep], r.end[keep], width[keep], height[keep], cache_bits[keep]
    top = max(1, *(int(s[keep].max()) for s in sizes))
    green, red, blue, alpha, distance = (_tables(s[keep], top).ravel() for s in sizes)
    n = width * height
    stop = np.cumsum(n)
    at = stop - n
    px = np.zeros(int(stop[-1]), _U32)
    most = int(cache_bits.max())
    cache, shift = np.zeros(len(own) << most if most else 0, _U32), (32 - cache_bits).astype(_U32)
    mask, plane = (1 << top) - 1, np.array(PLANE)
    live = np.arange(len(own))
    pos_, at_, base, view, first = pos.copy(), at.copy(), live << top, r.view, at.copy()
    finish = np.zeros(len(own), np.int64)

    def values(symbol: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra) + r.peek(p, extra) + 1, p + extra

    while len(live):
        w = (view[np.minimum(pos_ >> 3, len(view) - 1)] >> (pos_ & 7).astype(_U64)).astype(np.int64)
        e = green[base + (w & mask)].astype(np.int64)
        s, used = e >> 4, e & 15
        w >>= used
        a = red[base + (w & mask)].astype(np.int64)
        w >>= a & 15
        b = blue[base + (w & mask)].astype(np.int64)
        w >>= b & 15
        c = alpha[base + (w & mask)].astype(np.int64)
        new = ((c >> 4) << 24 | (a >> 4) << 16 | s << 8 | b >> 4).astype(_U32)
        bits = used + (a & 15) + (b & 15) + (c & 15)
        step = 1
        other = s >= 256
        if other.any():
            bits = np.where(other, used, bits)
            if most and len(old := np.flatnonzero(s >= GREEN)):
                new[old] = cache[(live[old] << most) + s[old] - GREEN]
            if len(k := np.flatnonzero(other & (s < GREEN))):
                p = pos_[k] + used[k]
                length, p = values(s[k] - 256, p)
                e = distance[base[k] + r.peek(p, top)].astype(np.int64)
                d, p = values(e >> 4, p + (e & 15))
                near = plane[np.minimum(d, 120) - 1]
                d = np.where(d > 120, d - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[live[k]]))
                bits[k] = p - pos_[k]
                if ((d > at_[k] - first[live[k]]) | (at_[k] + length > stop[live[k]])).any():
                    raise ValueError("a back-reference leaves the image")
                step = np.ones(len(live), np.int64)
                step[k] = length
                for i, o, m, x in zip(live[k].tolist(), at_[k].tolist(), length.tolist(), d.tolist(), strict=True):
                    got = px[o - x : o - x + m] if x >= m else np.resize(px[o - x : o], m)
                    px[o : o + m] = got
                    if cache_bits[i]:
                        cache[(i << most) + ((got * _U32(CACHE_HASH)) >> shift[i])] = got  # of equal places the last counts
                one = step == 1
                one[k] = False
                q = np.flatnonzero(one)
                px[at_[q]] = new[q]
                if most:
                    cache[(live[q] << most) + ((new[q] * _U32(CACHE_HASH)) >> shift[live[q]] & _U32((1 << most) - 1))] = new[q]
            else:
                px[at_] = new
                if most:
                    cache[(live << most) + ((new * _U32(CACHE_HASH)) >> shift[live] & _U32((1 << most) - 1))] = new
        else:
            px[at_] = new
            if most:
                cache[(live << most) + ((new * _U32(CACHE_HASH)) >> shift[live] & _U32((1 << most) - 1))] = new
        pos_ = pos_ + bits
        at_ = at_ + step
        done = at_ >= stop[live]
        if done.any():
            finish[live[done]] = pos_[done]
            on = ~done
            live, pos_, at_, base = live[on], pos_[on], at_[on], base[on]
    if (finish > end).any():
        raise ValueError("the stream ends early")
    for i, k in enumerate(own.tolist()):
        out[k] = (px[first[i] : stop[i]], int(width[i]), int(height[i]))
    return out
