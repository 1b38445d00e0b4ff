"""FLAC streams of 8-bit mono audio, written and read in numpy.

Frames of many streams are handled together: one step of a loop handles the
next sample, or byte, of all frames at once. The writer chooses, for each
frame, among constant, verbatim, fixed and linear predictors with partitioned
Rice residuals, and writes a seek point for each frame. The reader takes any
8-bit mono stream: all predictor orders, both Rice codings, escaped partitions
and wasted bits; it checks the CRC-8 of headers, the CRC-16 of frames and the
MD5 of the audio. Without a seek table it walks from frame to frame.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 1024
RATE_HZ = 8000
PARTITION_ORDER = 2
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LPC_PRECISION = 12


def _table(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crcs(buf: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """CRC of many byte ranges, in step over their positions."""
    order = np.argsort(-size, kind="stable")
    begin, n = start[order], size[order]
    crc = np.zeros(len(n), dtype=np.int64)
    mask = (1 << width) - 1
    for i in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -i, side="left"))
        crc[:live] = crc[:live] << 8 & mask ^ table[crc[:live] >> (width - 8) ^ buf[begin[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            break
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """Quantised predictor coefficients of each row of x (autocorrelation method)."""
    w = x.astype(float)
    r = np.stack([(w[:, : x.shape[1] - k] * w[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), order))
    error = r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= np.maximum(1 - k * k, 1e-12)
    shift = LPC_PRECISION - 3
    limit = 1 << (LPC_PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)), -limit, limit - 1).astype(np.int64), shift


def _residual(x: np.ndarray, coefs: np.ndarray, shift: int) -> np.ndarray:
    order = coefs.shape[1]
    if not order:
        return x
    guess = sum(coefs[:, j, None] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
    return x[:, order:] - (guess >> shift)


def _rice(res: np.ndarray, n: int, order: int, po: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag residuals, Rice parameter of each partition and bits of each row."""
    z = res << 1 ^ res >> 63
    size = n >> po
    edges = [0, *[size * p - order for p in range(1, 1 << po)]]
    counts = np.diff([*edges, n - order])
    total = np.add.reduceat(z, edges, axis=1)
    mean = total / np.maximum(counts, 1)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 13).astype(np.int64)
    best, param = None, k0
    for k in (k0, k0 + 1):
        bits = np.add.reduceat(z >> np.repeat(k, counts, axis=1), edges, axis=1) + counts * (k + 1) + 4
        if best is None:
            best = bits
        else:
            param = np.where(bits < best, k, param)
            best = np.minimum(bits, best)
    return z, param, best.sum(axis=1) + 6


def encode_frames(samples: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, fixed=(0, 1, 2), lpc=(4,), po: int = PARTITION_ORDER) -> tuple[bytes, np.ndarray]:
    """Frames of consecutive runs of 8-bit samples; the bytes and their offsets."""
    count = len(lengths)
    first = np.cumsum(lengths) - lengths
    heads, fields, body_bits = [], [], np.zeros(count, dtype=np.int64)
    for n, number in zip(lengths.tolist(), numbers.tolist(), strict=True):
        standard = {256 << i: 8 + i for i in range(8)}.get(n)
        head = bytes([0xFF, 0xF8, (standard or 7) << 4, 0x02]) + _number(number)
        heads.append(head if standard else head + struct.pack(">H", n - 1))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        x = samples[first[rows][:, None] + np.arange(n)].astype(np.int64)
        p = po
        while p and (n % (1 << p) or n >> p <= max([0, *fixed, *lpc])):
            p -= 1
        options = [("fixed", o, np.tile(np.array(FIXED[o], dtype=np.int64), (len(rows), 1)), 0) for o in fixed if o < n]
        options += [("lpc", o, *_lpc(x, o)) for o in lpc if o < n]
        coded = [(kind, o, c, s, *_rice(_residual(x, c, s), n, o, p)) for kind, o, c, s in options]
        costs = [bits + 8 + 8 * o + ((9 + LPC_PRECISION * o) if kind == "lpc" else 0) for kind, o, _, _, _, _, bits in coded]
        same = (x == x[:, :1]).all(axis=1)
        table = np.stack([np.where(same, 16, 1 << 60), np.full(len(rows), 8 + 8 * n), *costs])
        pick = table.argmin(axis=0)
        body_bits[rows] = table.min(axis=0)
        for choice in np.unique(pick).tolist():
            mine = np.flatnonzero(pick == choice)
            at, own = rows[mine], x[mine]
            if choice == 0:
                fields.append((at, [(0, 8), (own[:, :1] & 255, 8)], None))
            elif choice == 1:
                fields.append((at, [(2, 8), (own & 255, 8)], None))
            else:
                kind, o, c, s, z, param, _ = coded[choice - 2]
                lead = [((8 + o if kind == "fixed" else 31 + o) << 1, 8)]
                if o:
                    lead.append((own[:, :o] & 255, 8))
                if kind == "lpc":
                    lead += [(LPC_PRECISION - 1, 4), (s, 5), (c[mine] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)]
                lead += [(0, 2), (p, 4)]
                fields.append((at, lead, (z[mine], param[mine], n, o, p)))
    head_size = np.array([len(h) + 1 for h in heads], dtype=np.int64)
    size = head_size + (body_bits + 7) // 8 + 2
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, dtype=np.uint8)

    def put(pos, values, width):
        for b in range(width):
            bits[pos + b] = values >> (width - 1 - b) & 1

    for at, lead, residual in fields:
        pos = (start[at] + head_size[at]) * 8
        for value, width in lead:
            value = np.broadcast_to(np.asarray(value, dtype=np.int64), (len(at), 1)) if np.ndim(value) == 0 else value
            put(pos[:, None] + np.arange(value.shape[1]) * width, value, width)
            pos = pos + value.shape[1] * width
        if residual is None:
            continue
        z, param, n, o, p = residual
        counts = np.diff([0, *[(n >> p) * k - o for k in range(1, 1 << p)], n - o])
        k = np.repeat(param, counts, axis=1)
        q = z >> k
        width = q + 1 + k
        width[:, np.cumsum(counts) - counts] += 4
        stop = pos[:, None] + np.cumsum(width, axis=1)  # the end of each code
        put(stop[:, np.cumsum(counts) - counts] - width[:, np.cumsum(counts) - counts], param, 4)
        bits[stop - k - 1] = 1
        for b in range(int(k.max())):
            some = k > b
            bits[(stop - 1 - b)[some]] = (z >> b & 1)[some]
    out = np.packbits(bits)
    del bits
    for h, s in zip(heads, start.tolist(), strict=True):
        out[s : s + len(h)] = np.frombuffer(h, dtype=np.uint8)
    out[start + head_size - 1] = crcs(out, start, head_size - 1, CRC8, 8)
    check = crcs(out, start, size - 2, CRC16, 16)
    out[start + size - 2], out[start + size - 1] = check >> 8, check & 255
    return out.tobytes(), np.append(start, len(out))


@dataclass
class Frames:
    samples: np.ndarray  # of all frames, in order
    lengths: np.ndarray
    ends: np.ndarray  # first byte after each frame
    ok: np.ndarray  # both checksums


def decode_frames(data: bytes, starts: np.ndarray) -> Frames:
    """Decode the frames that begin at the given bytes, in step."""
    buf = np.frombuffer(data + b"\xff" * 4096, dtype=np.uint8)
    words = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf.data, strides=(1,))
    last = len(words) - 1
    one = np.uint64(1)

    def top(pos):
        return words[np.minimum(pos >> 3, last)].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def read(pos, width):
        """Unsigned fields of at most 57 bits."""
        return (top(pos) >> one >> (np.uint64(63) - np.asarray(width).astype(np.uint64))).astype(np.int64)

    def signed(pos, width):
        v = read(pos, width)
        return np.where(width > 0, v - ((v >> np.maximum(width - 1, 0) & 1) << width), 0)

    count = len(starts)
    starts = np.asarray(starts, dtype=np.int64)
    ok = (buf[starts] == 0xFF) & (buf[starts + 1] & 0xFE == 0xF8)
    code, rate = buf[starts + 2] >> 4, buf[starts + 2] & 15
    lead = buf[starts + 4]
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    at = starts + 5 + more
    eight, sixteen = buf[at].astype(np.int64), buf[at].astype(np.int64) << 8 | buf[at + 1]
    n = np.select([code == 1, code < 6, code == 6, code == 7], [192, 576 << np.maximum(code.astype(np.int64) - 2, 0), eight + 1, sixteen + 1], 256 << np.maximum(code.astype(np.int64) - 8, 0)).astype(np.int64)
    at = at + np.select([code == 6, code == 7], [1, 2], 0)
    at = at + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    ok &= (code > 0) & ((buf[starts + 3] >> 4) == 0) & np.isin(buf[starts + 3] >> 1 & 7, (0, 1))
    ok &= crcs(buf, starts, at - starts, CRC8, 8) == buf[at]
    n = np.where(ok, n, 0)
    pos = (at + 1) * 8
    kind, wasted = read(pos, 8) >> 1 & 63, read(pos, 8) & 1
    pos = pos + 8
    extra = np.zeros(count, dtype=np.int64)
    if wasted.any():  # unary count of wasted bits
        w = np.flatnonzero(wasted)
        zeros = 32 - np.frexp((top(pos[w]) >> np.uint64(32)).astype(float))[1]
        extra[w] = zeros + 1
        pos[w] += zeros + 1
    width = 8 - extra
    order = np.select([(kind >= 8) & (kind <= 12), kind >= 32], [kind - 8, kind - 31], 0)
    ok &= (kind < 2) | (kind >= 8) & (kind <= 12) | (kind >= 32)
    most = int(n.max()) if count else 0
    x = np.zeros((most, count), dtype=np.int64)
    rank = np.argsort(-n, kind="stable")  # columns by falling length
    column = np.empty(count, dtype=np.int64)
    column[rank] = np.arange(count)
    plain = np.flatnonzero(kind == 0)
    if len(plain):
        x[:, column[plain]] = signed(pos[plain], width[plain])
        pos[plain] += width[plain]
    raw = np.flatnonzero(kind == 1)
    if len(raw):
        steps = np.arange(most)[:, None]
        x[:, column[raw]] = signed(pos[raw] + steps * width[raw], np.broadcast_to(width[raw], (most, len(raw))))
        pos[raw] += n[raw] * width[raw]
    rest = rank[(kind[rank] >= 8) & ok[rank]]
    if len(rest):
        o, col, size = order[rest], column[rest], n[rest]
        here = pos[rest]
        deepest = int(o.max())
        for i in range(deepest):
            some = np.flatnonzero(o > i)
            x[i, col[some]] = signed(here[some], width[rest][some])
            here[some] += width[rest][some]
        coefs, shift = np.zeros((len(rest), deepest), dtype=np.int64), np.zeros(len(rest), dtype=np.int64)
        for f, taps in enumerate(FIXED):
            some = kind[rest] == 8 + f
            if f and some.any():
                coefs[some, :f] = taps
        lin = np.flatnonzero(kind[rest] >= 32)
        if len(lin):
            precision = read(here[lin], 4) + 1
            shift[lin] = signed(here[lin] + 4, np.full(len(lin), 5))
            here[lin] += 9
            for i in range(int(o[lin].max())):
                some = o[lin] > i
                coefs[lin[some], i] = signed(here[lin[some]], precision[some])
                here[lin[some]] += precision[some]
        wide = np.where(read(here, 2) == 1, 5, 4)
        part = size >> read(here + 2, 4)
        here = here + 6
        edge, escapes = o.copy(), False  # the first partition starts after the warm-up
        k, escape = np.zeros(len(rest), dtype=np.int64), np.zeros(len(rest), dtype=np.int64)
        low = int(o.min())
        for i in range(low, most):
            live = int(np.searchsorted(-size, -i, side="left"))
            due = np.flatnonzero((edge[:live] == i) & (o[:live] <= i))
            if len(due):
                bits = wide[due]
                k[due] = read(here[due], bits)
                here[due] += bits
                esc = k[due] == (1 << bits) - 1
                escape[due] = 0
                if esc.any():
                    e = due[esc]
                    escape[e] = read(here[e], 5) + 1  # one more than the raw width
                    here[e] += 5
                edge[due] = (i // part[due] + 1) * part[due]
                escapes = bool(escape.any())
            if i < deepest or escapes:
                some = np.flatnonzero((o[:live] <= i) & (escape[:live] == 0))
                fixed_width = np.flatnonzero((o[:live] <= i) & (escape[:live] > 0))
                if len(fixed_width):
                    w = escape[fixed_width] - 1
                    x[i, col[fixed_width]] = signed(here[fixed_width], w)
                    here[fixed_width] += w
            else:
                some = slice(0, live)
            p, kk = here[some], k[some]
            word = top(p)
            head = (word >> np.uint64(32)).astype(np.float64)
            zeros = (32 - np.frexp(head)[1]).astype(np.int64)
            if (head == 0).any():  # long unary runs
                far = np.flatnonzero(head == 0)
                extra_zeros, spot = np.zeros(len(far), dtype=np.int64), p[far] + 32
                open_ = np.arange(len(far))
                while len(open_):
                    h = (top(spot[open_]) >> np.uint64(32)).astype(np.float64)
                    step = np.where(h == 0, 32, 32 - np.frexp(h)[1])
                    extra_zeros[open_] += step
                    spot[open_] += step
                    open_ = open_[(h == 0) & (spot[open_] < len(data) * 8)]
                zeros[far] = 32 + extra_zeros
                value = zeros << kk | np.where(kk > 0, read(p + zeros + 1, np.maximum(kk, 1)), 0)
            else:
                value = zeros << kk | (word << (zeros + 1).astype(np.uint64) >> one >> (np.uint64(63) - kk.astype(np.uint64))).astype(np.int64)
            here[some] = p + zeros + 1 + kk
            x[i, col[some]] = value >> 1 ^ -(value & 1)
        pos[rest] = here
        for depth in np.unique(o[o > 0]).tolist():
            mine = np.flatnonzero(o == depth)
            c, s = coefs[mine, :depth].T.copy(), shift[mine]
            y = x[:, col[mine]]
            for i in range(depth, most):
                guess = c[0] * y[i - 1]
                for j in range(1, depth):
                    guess += c[j] * y[i - 1 - j]
                y[i] += guess >> s
            x[:, col[mine]] = y
    if extra.any():
        x[:, column] <<= extra
    ends = (pos + 7 >> 3) + 2
    ok &= ends <= len(data)
    ends = np.where(ok, ends, starts + 2)
    check = crcs(buf, starts, ends - 2 - starts, CRC16, 16)
    ok &= check == (buf[ends - 2].astype(np.int64) << 8 | buf[ends - 1])
    keep = np.arange(most)[None, :] < n[:, None]
    return Frames(x.T[column][keep], n, ends, ok)


def write_stream(frames: list[bytes], lengths: list[int], pcm: bytes) -> bytes:
    """A whole stream: STREAMINFO, a seek point for each frame, frames. pcm is
    the signed 8-bit audio, for the MD5."""
    sizes = [len(f) for f in frames]
    most = max(lengths)
    small = min(lengths[:-1], default=most)
    info = struct.pack(">HH", max(16, small), max(16, most)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE_HZ << 44 | 0 << 41 | 7 << 36 | sum(lengths)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    at = np.cumsum([0, *lengths])[:-1], np.cumsum([0, *sizes])[:-1]
    points = np.zeros(len(frames), dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
    points["sample"], points["offset"], points["count"] = at[0], at[1], lengths
    table = points.tobytes()
    if len(table) >= 1 << 24:  # too long for a block: the reader walks
        return b"fLaC\x80\x00\x00\x22" + info + b"".join(frames)
    return b"fLaC\x00\x00\x00\x22" + info + b"\x03" + len(table).to_bytes(3, "big") + table + _PADDING + b"".join(frames)


#: An empty last PADDING block ends the metadata.
_PADDING = b"\x81\x00\x00\x00"


@dataclass
class Stream:
    total: int
    md5: bytes
    audio: int  # byte of the first frame
    points: np.ndarray | None  # (sample, offset) of each frame, if all are listed


def read_header(data: bytes) -> Stream:
    """Metadata of a stream; ValueError if it is not an 8-bit mono one."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, info, points = 4, None, None
    while True:
        if at + 4 > len(data):
            raise ValueError("metadata ends early")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 127 == 0:
            info = block
        elif kind & 127 == 3:
            points = np.frombuffer(block[: len(block) // 18 * 18], dtype=[("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        if kind & 128:
            break
    if info is None or len(info) < 34:
        raise ValueError("no STREAMINFO")
    word = int.from_bytes(info[10:18], "big")
    if word >> 41 & 7 or word >> 36 & 31 != 7:
        raise ValueError("not 8-bit mono")
    total = word & (1 << 36) - 1
    if points is not None:
        points = points[points["sample"] != (1 << 64) - 1]
        sample, n = points["sample"].astype(np.int64), points["count"].astype(np.int64)
        whole = len(points) and sample[0] == 0 and (sample[1:] == sample[:-1] + n[:-1]).all() and sample[-1] + n[-1] == total
        points = np.stack([sample, points["offset"].astype(np.int64)]) if whole else None
    return Stream(total, info[18:34], at, points)
