"""FLAC media columns: lossless streams in a binary column, decoded into seekable PCM blocks.

Frames are coded and decoded in lockstep, one sample of every frame of a block of streams at a
time, so that the serial parts (Rice codes, whose places depend on the codes before, and linear
prediction) run as array operations over frames. Streams carry a seek table with every frame;
those without one are searched for frame headers, which must have valid check sums and follow
on one another. Every header's CRC-8, every frame's CRC-16 and the stream's MD5 are verified.

Layout follows the public FLAC format (RFC 9639): constant, verbatim, fixed and LPC subframes,
both Rice methods with escapes, wasted bits, and mono or (decorrelated) stereo.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, per_row, utf8

BLOCK = 512
RATE = 8000
PARTITION_ORDER = 2
LPC_ORDER = 6
LPC_PRECISION = 10
MAX_RICE = 10
PAD = 64
#: Bytes of payload that are coded together, about, and frames that are coded or decoded in lockstep, at most: a long stream is worked off in parts.
TOGETHER = 2 << 20
FRAMES = 4096

FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that breaks the format or fails a check sum."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(rows: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Check sums of rows of bytes; zeros in front leave them as they are."""
    crc, mask, shift = np.zeros(len(rows), np.uint32), np.uint32((1 << bits) - 1), np.uint32(bits - 8)
    for col in np.ascontiguousarray(rows.T):
        crc = ((crc << np.uint32(8)) & mask) ^ table[(crc >> shift) ^ col]
    return crc


def _right_aligned(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Spans of ``buf`` as rows, with zeros in front."""
    width = int(length.max(initial=0))
    at = (start + length)[:, None] - width + np.arange(width)
    return np.where(at >= start[:, None], buf[np.maximum(at, 0)], 0).astype(np.uint8)


def _number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


# --- coding -------------------------------------------------------------------------------


def _lpc(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of each row, by Levinson and Durbin's recursion."""
    f = x.astype(np.float64)
    n = f.shape[1]
    r = np.stack([(f[:, : n - k] * f[:, k:]).sum(1) for k in range(order + 1)])
    r[0] += 1e-9 + r[0] * 1e-9
    a = np.zeros((order, len(f)))
    err = r[0].copy()
    for i in range(order):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / err
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.abs(a).max(0)
    shift = np.clip(precision - 1 - np.ceil(np.log2(np.maximum(top, 1e-6)) + 1e-9), 0, 15).astype(np.int64)
    lim = 1 << (precision - 1)
    q = np.clip(np.rint(a * (1 << shift)), -lim, lim - 1).astype(np.int64)
    return q.T, shift


def _residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coefs.shape[1]
    pred = np.zeros((len(x), x.shape[1] - order), np.int64)
    for j in range(order):
        pred += coefs[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return x[:, order:] - (pred >> shift[:, None])


def _put(bits: np.ndarray, at: np.ndarray, value, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _code_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equally long rows of 8-bit samples; each takes the predictor with the smallest estimate."""
    count, n = x.shape
    x = x.astype(np.int64)
    best = np.full(count, 1 << 60)
    kind = np.zeros(count, np.int64)
    lpc, lpc_shift = _lpc(x, LPC_ORDER, LPC_PRECISION)
    tries = [(o, np.tile(np.array(FIXED[o], np.int64), (count, 1)), np.zeros(count, np.int64), 0) for o in range(5)]
    tries.append((LPC_ORDER, lpc, lpc_shift, 9 + LPC_ORDER * LPC_PRECISION))
    codes = []
    for k, (order, coefs, shift, extra) in enumerate(tries):
        r = _residual(x, coefs, shift)
        u = np.where(r < 0, -2 * r - 1, 2 * r)
        mean = u.mean(1)
        est = (np.log2(mean + 1) * (n - order)).astype(np.int64) + 8 * order + extra
        kind = np.where(est < best, k, kind)
        best = np.minimum(est, best)
        codes.append(u)
    out: list[bytes] = [b""] * count
    for k, (order, coefs, shift, extra) in enumerate(tries):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            frames = _code_alike(x[rows], codes[k][rows], order, coefs[rows], shift[rows], bool(extra), [numbers[i] for i in rows])
            for i, frame in zip(rows, frames, strict=True):
                out[i] = frame
    return out


def _code_alike(x, u, order, coefs, shift, is_lpc, numbers) -> list[bytes]:
    """Frames with the same length and kind of predictor."""
    count, n = x.shape
    parts, size = 1 << PARTITION_ORDER, n >> PARTITION_ORDER
    full = np.concatenate([np.zeros((count, order), np.int64), u], axis=1).reshape(count, parts, size)
    real = np.full(parts, size)
    real[0] -= order
    costs = np.stack([(full >> k).sum(2) + real * (k + 1) for k in range(MAX_RICE + 1)])
    rice = costs.argmin(0)
    k = np.repeat(rice, size, axis=1)[:, order:]
    q = u >> k
    length = q + 1 + k
    # within the frame, in bits: header, subframe header, warm-up, coefficients, residual's header, parameters before codes
    heads = [b"\xff\xf8" + bytes([0x90 if n == BLOCK else 0x70, 0x02]) + _number(i) + (b"" if n == BLOCK else struct.pack(">H", n - 1)) for i in numbers]
    head_len = np.array([len(h) for h in heads])
    padded = np.zeros((count, int(head_len.max())), np.uint8)
    for row, h in zip(padded, heads, strict=True):
        row[len(row) - len(h) :] = np.frombuffer(h, np.uint8)
    crc8 = _crc(padded, CRC8, 8)
    lead = 8 * (head_len + 1)
    body = 8 + 8 * order + (9 + order * LPC_PRECISION if is_lpc else 0) + 6
    param_at_sample = np.zeros((1, n - order), np.int64)
    param_at_sample[0, 0] = 4
    param_at_sample[0, [p * size - order for p in range(1, parts)]] = 4
    ends = np.cumsum(length + param_at_sample, axis=1)
    bits_len = lead + body + ends[:, -1]
    n_bytes = (bits_len + 7) // 8 + 2
    base = 8 * np.concatenate([[0], np.cumsum(n_bytes)])
    bits = np.zeros(int(base[-1]), np.uint8)
    base = base[:-1]
    for row, h in enumerate(heads):
        at = int(base[row])
        bits[at : at + 8 * len(h)] = np.unpackbits(np.frombuffer(h, np.uint8))
    at = base + 8 * head_len
    _put(bits, at, crc8.astype(np.int64), 8)
    at = at + 8
    _put(bits, at, np.full(count, (0x20 | (order - 1) if is_lpc else 0x08 | order) << 1), 8)
    at = at + 8
    for j in range(order):
        _put(bits, at, x[:, j] & 0xFF, 8)
        at = at + 8
    if is_lpc:
        _put(bits, at, np.full(count, LPC_PRECISION - 1), 4)
        _put(bits, at + 4, shift, 5)
        at = at + 9
        for j in range(order):
            _put(bits, at, coefs[:, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
            at = at + LPC_PRECISION
    _put(bits, at, np.full(count, PARTITION_ORDER), 6)
    at = at + 6
    start = at[:, None] + ends - length
    for p in range(parts):
        first = max(0, p * size - order)
        _put(bits, start[:, first] - 4, rice[:, p], 4)
    stop = (start + q).ravel()
    bits[stop] = 1
    flat_u, flat_k = u.ravel(), k.ravel()
    for j in range(int(flat_k.max())):
        on = np.flatnonzero(((flat_u >> j) & 1).astype(bool) & (flat_k > j))
        bits[stop[on] + flat_k[on] - j] = 1
    raw = np.packbits(bits)
    begin = base // 8
    crc = _crc(_right_aligned(raw, begin, n_bytes - 2), CRC16, 16)
    raw[begin + n_bytes - 2], raw[begin + n_bytes - 1] = crc >> 8, crc & 0xFF
    blob = raw.tobytes()
    return [blob[a : a + m] for a, m in zip(begin.tolist(), n_bytes.tolist(), strict=True)]


def encode_streams(payloads: list[bytes], rate: int = RATE) -> list[bytes]:
    """A mono 8-bit stream for each payload, whose bytes are samples with their top bit flipped."""
    by_len: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for b in range(0, len(p), BLOCK):
            by_len.setdefault(min(BLOCK, len(p) - b), []).append((i, b // BLOCK))
    frames: dict[tuple[int, int], bytes] = {}
    for n, keys in ((n, keys[k : k + FRAMES]) for n, keys in by_len.items() for k in range(0, len(keys), FRAMES)):
        x = np.frombuffer(b"".join(payloads[i][b * BLOCK : b * BLOCK + n] for i, b in keys), np.uint8)
        x = (x ^ 0x80).view(np.int8).reshape(-1, n)
        frames.update(zip(keys, _code_frames(x, [b for _, b in keys]), strict=True))
    out = []
    for i, p in enumerate(payloads):
        own = [frames[i, b] for b in range(-(-len(p) // BLOCK))]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        sizes = [len(f) for f in own]
        packed = rate << 44 | 0 << 41 | 7 << 36 | len(p)
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek, at = [], 0
        for b, size in enumerate(sizes):
            seek.append(struct.pack(">QQH", b * BLOCK, at, min(BLOCK, len(p) - b * BLOCK)))
            at += size
        table = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


# --- decoding -----------------------------------------------------------------------------


class _Bits:
    """Bit reads at many places of one buffer at a time."""

    def __init__(self, buf: np.ndarray):
        wide = np.zeros(len(buf) + 16, np.uint8)
        wide[: len(buf)] = buf
        self.words = np.zeros(len(buf) + 8, np.uint64)
        for j in range(8):
            self.words |= wide[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.last = np.int64(len(self.words) - 1)

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place, of which 57 at least are right."""
        return self.words[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        w = np.asarray(width, np.int64)
        return ((self.window(at) >> np.uint64(1)) >> (63 - w).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        w = np.asarray(width, np.int64)
        v = self.read(at, w)
        return np.where(w > 0, v - ((v >> np.maximum(w - 1, 0)) << w) * (w > 0), 0)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        top = self.window(at) >> np.uint64(11)
        n = 52 - ((top.astype(np.float64).view(np.int64) >> 52) - 1023)
        far = (top < 128).nonzero()[0]
        if len(far):
            n[far] = 0
            place = at[far].copy()
            todo = np.arange(len(far))
            while len(todo):
                got = self.read(place[todo], 32)
                none = got == 0
                lead = 31 - (np.maximum(got, 1).astype(np.float64).view(np.int64) >> 52) + 1023
                n[far[todo]] += np.where(none, 32, lead)
                place[todo] += 32
                if (place[todo] > 8 * int(self.last) + 64).any():
                    raise FlacError("a Rice code runs past the stream's end")
                todo = todo[none]
        return n


def _subframes(bits: _Bits, at: np.ndarray, n: np.ndarray, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [longest, frames] of one subframe in each frame, and where each ends. Longest frames come first."""
    count, longest = len(n), int(n[0])
    head = bits.read(at, 8)
    if (head & 0x80).any():
        raise FlacError("a subframe has no zero bit in front")
    at = at + 8
    wasted = np.zeros(count, np.int64)
    has = np.flatnonzero(head & 1)
    if len(has):
        wasted[has] = bits.zeros(at[has]) + 1
        at[has] += wasted[has]
    kind, bps = head >> 1, bps - wasted
    out = np.zeros((longest, count), np.int64)
    const, verb = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(fixed | lpc) & (kind > 1)).any():
        raise FlacError("a subframe of a reserved kind")
    if len(const):
        out[:, const] = bits.signed(at[const], bps[const])
        at[const] += bps[const]
    for i in range(int(n[verb].max(initial=0))):
        v = verb[n[verb] > i]
        out[i, v] = bits.signed(at[v], bps[v])
        at[v] += bps[v]
    p = np.flatnonzero(fixed | lpc)
    if len(p):
        order = np.where(fixed[p], kind[p] - 8, kind[p] - 31)
        most = int(order.max())
        pos, w, size = at[p], bps[p], n[p]
        got = np.zeros((longest + most, len(p)), np.int64)  # most rows of zeros in front
        for i in range(most):
            on = np.flatnonzero(order > i)
            got[most + i, on] = bits.signed(pos[on], w[on])
            pos[on] += w[on]
        coefs, shift = np.zeros((max(most, 1), len(p)), np.int64), np.zeros(len(p), np.int64)
        for o, c in enumerate(FIXED[: most + 1]):
            on = fixed[p] & (order == o)
            for j, v in enumerate(c):
                coefs[j, on] = v
        on = np.flatnonzero(lpc[p])
        if len(on):
            precision = bits.read(pos[on], 4) + 1
            shift[on] = bits.signed(pos[on] + 4, 5)
            if (precision == 16).any() or (shift < 0).any():
                raise FlacError("linear prediction with a forbidden precision or shift")
            pos[on] += 9
            for j in range(most):
                sub = order[on] > j
                coefs[j, on[sub]] = bits.signed(pos[on[sub]], precision[sub])
                pos[on[sub]] += precision[sub]
        method = bits.read(pos, 2)
        if (method > 1).any():
            raise FlacError("a residual of a reserved method")
        width, part = 4 + method, size >> bits.read(pos + 2, 4)
        pos += 6
        rice, raw = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        step = int(np.gcd.reduce(np.maximum(part, 1)))
        back = slice(None)
        for i in range(longest):
            live = int(np.searchsorted(-size, -i, side="left"))  # sizes fall; those over i
            if i <= most or i % step == 0:
                new = np.flatnonzero((order[:live] <= i) & ((order[:live] == i) | (i % np.maximum(part[:live], 1) == 0)))
                if len(new):
                    rice[new] = bits.read(pos[new], width[new])
                    pos[new] += width[new]
                    raw[new] = rice[new] == (1 << width[new]) - 1
                    esc = new[raw[new]]
                    rice[esc] = bits.read(pos[esc], 5)
                    pos[esc] += 5
                any_raw = raw.any()
            back = slice(0, live) if i >= most else np.flatnonzero(order[:live] <= i)
            k, here = rice[back], pos[back]
            q = bits.zeros(here) if not any_raw else np.where(raw[back], -1, bits.zeros(np.where(raw[back], 0, here)) if not raw[back].all() else -1)
            here = here + q + 1
            low = bits.read(here, k)
            code = (np.maximum(q, 0) << k) | low
            r = (code >> 1) ^ -(code & 1)
            if any_raw:
                r = np.where(raw[back], bits.signed(here, k), r)
            pos[back] = here + k
            if most:
                pred = np.einsum("jf,jf->f", coefs[:most, back], got[i : i + most][::-1][:, back])
                r = r + (pred >> shift[back])
            got[most + i, back] = r
        out[:, p] = got[most:]
        at[p] = pos
    return out << wasted, at


_RATE_EXTRA = {12: 1, 13: 2, 14: 2}
_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _header(raw: bytes, at: int, bps: int) -> tuple[int, int, int, int, int, int]:
    """Of the frame at a place: header bytes, samples, channel code, bits per sample, number, whether that counts samples."""
    if len(raw) < at + 6 or raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should begin")
    block, rate, chan, size = raw[at + 2] >> 4, raw[at + 2] & 15, raw[at + 3] >> 4, raw[at + 3] >> 1 & 7
    lead = raw[at + 4]
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not extra else lead & (0x3F >> extra)
    for b in raw[at + 5 : at + 5 + extra]:
        number = number << 6 | b & 0x3F
    end = at + 5 + extra
    if block == 6:
        n, end = raw[end] + 1, end + 1
    elif block == 7:
        n, end = int.from_bytes(raw[end : end + 2], "big") + 1, end + 2
    else:
        n = 192 if block == 1 else 576 << (block - 2) if 2 <= block <= 5 else 256 << (block - 8) if block >= 8 else 0
    end += _RATE_EXTRA.get(rate, 0)
    crc = 0
    for b in raw[at:end]:
        crc = int(CRC8[crc ^ b])
    if not n or end >= len(raw) or crc != raw[end]:
        raise FlacError("a frame header fails its check sum")
    return end + 1 - at, n, chan, _SIZES.get(size, bps), number, raw[at + 1] & 1


def _metadata(raw: bytes) -> tuple[dict, list[int], int]:
    """STREAMINFO's fields, the frame offsets of a complete seek table, and where frames begin."""
    if raw[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info, seek, last = 4, None, [], False
    while not last:
        if at + 4 > len(raw):
            raise FlacError("the metadata are cut off")
        last, kind, size = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bps": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [struct.unpack_from(">QQH", body, o) for o in range(0, size - 17, 18)]
            seek = [p for p in points if p[0] != (1 << 64) - 1]
        at += 4 + size
    if info is None:
        raise FlacError("no STREAMINFO")
    whole = seek and seek[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(seek, seek[1:], strict=False)) and seek[-1][0] + seek[-1][2] == info["samples"]
    return info, [p[1] for p in seek] if whole else [], at


def _search(raw: bytes, at: int, bps: int) -> list[int]:
    """Frame places by their headers, which count up."""
    places, expect = [], 0
    for m in re.compile(rb"\xff[\xf8\xf9]").finditer(raw, at):
        try:
            _, n, _, _, number, counts_samples = _header(raw, m.start(), bps)
        except FlacError:
            continue
        if number == expect:
            places.append(m.start())
            expect += n if counts_samples else 1
    return places


def _decode_frames(joined: np.ndarray, frames: list[tuple]) -> dict[int, np.ndarray]:
    """Samples [channels, n] by frame number; ``frames`` are (samples, frame number, place, end, header bytes, channel code, bits per sample)."""
    base = min(f[2] for f in frames)
    joined = joined[base : max(f[3] for f in frames)]
    n, idx, place, end, size, chan, bps = (np.array(c, np.int64) for c in zip(*sorted(frames, key=lambda f: -f[0]), strict=True))
    place, end = place - base, end - base
    crc = _crc(_right_aligned(joined, place, end - place - 2), CRC16, 16)
    if (crc != joined[end - 2].astype(np.uint32) << np.uint32(8) | joined[end - 1]).any():
        raise FlacError("a frame fails its check sum")
    if (chan > 10).any():
        raise FlacError("a frame of a reserved channel code")
    bits = _Bits(joined)
    at = 8 * (place + size)
    n_chan = np.where(chan < 8, chan + 1, 2)
    got = []
    for c in range(int(n_chan.max())):
        on = np.flatnonzero(n_chan > c)
        side = ((chan == 8) & (c == 1)) | ((chan == 9) & (c == 0)) | ((chan == 10) & (c == 1))
        x, at[on] = _subframes(bits, at[on], n[on], bps[on] + side[on])
        full = np.zeros((int(n[0]), len(n)), np.int64)
        full[: len(x), on] = x
        got.append(full)
    if ((at + 7) // 8 != end - 2).any():
        raise FlacError("a frame does not end where its codes do")
    if len(got) > 1:
        a, b = got[0], got[1]
        mid = (a << 1) | (b & 1)
        got[0] = np.where(chan == 9, a + b, np.where(chan == 10, (mid + b) >> 1, a))
        got[1] = np.where(chan == 8, a - b, np.where(chan == 10, (mid - b) >> 1, b))
    return {int(i): np.stack([x[: n[k], k] for x in got[: n_chan[k]]]).astype(np.int32) for k, i in enumerate(idx)}


def decode_streams(streams: list[bytes]) -> list[tuple[dict, np.ndarray, list[int]]]:
    """STREAMINFO, samples [channels, n] and the frames' first samples, of each stream; raises FlacError on any damage."""
    frames: list[tuple] = []
    metas, own = [], []
    joined = np.frombuffer(b"".join(streams), np.uint8)
    base = 0
    for raw in streams:
        info, seek, first = _metadata(raw)
        places = [first + o for o in seek] or _search(raw, first, info["bps"])
        if info["samples"] and not places:
            raise FlacError("no frames")
        metas.append(info)
        own.append(range(len(frames), len(frames) + len(places)))
        for place, end in zip(places, [*places[1:], len(raw)], strict=True):
            size, n, chan, bps, _, _ = _header(raw, place, info["bps"])
            frames.append((n, len(frames), base + place, base + end, size, chan, bps))
        base += len(raw)
    made: dict[int, np.ndarray] = {}
    for k in range(0, len(frames), FRAMES):
        made |= _decode_frames(joined, frames[k : k + FRAMES])
    out: list[tuple[dict, np.ndarray, list[int]]] = []
    for info, numbers in zip(metas, own, strict=True):
        parts = [made.pop(i) for i in numbers]
        if any(len(p) != info["channels"] for p in parts):
            raise FlacError("a frame's channels are not the header's")
        pcm = np.concatenate(parts, axis=1) if parts else np.zeros((info["channels"], 0), np.int32)
        starts = np.cumsum([0] + [p.shape[1] for p in parts])[:-1].tolist()
        if info["samples"] and pcm.shape[1] != info["samples"]:
            raise FlacError("the samples' number is not the header's")
        if any(info["md5"]) and hashlib.md5(_plain(info, pcm)).digest() != info["md5"]:
            raise FlacError("the samples fail the stream's check sum")
        out.append((info, pcm, starts))
    return out


def _plain(info: dict, pcm: np.ndarray) -> bytes:
    """Samples interleaved, little-endian in whole bytes."""
    width = -(-info["bps"] // 8)
    flat = pcm.T.reshape(-1)
    wide = {1: "<i1", 2: "<i2", 4: "<i4"}.get(width)
    return flat.astype(wide).tobytes() if wide else flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def pcm_blocks(info: dict, pcm: np.ndarray, starts: list[int]) -> Iterator[tuple[int, int, int, bytes]]:
    """Block number, sample offset, samples and PCM bytes of each frame."""
    for b, (at, end) in enumerate(zip(starts, [*starts[1:], pcm.shape[1]], strict=True)):
        yield b, at, end - at, _plain(info, pcm[:, at:end])


def read_streams(media: list[bytes | None]) -> list[tuple[tuple[dict, np.ndarray, list[int]] | None, str | None]]:
    """What each stream decodes to, or why it doesn't; one damaged stream doesn't stop the others."""
    there = [m for m in media if m is not None]
    try:
        got = iter([(x, None) for x in decode_streams(there)])
    except DAMAGE:
        got = iter([_read_one(m) for m in there])
    return [(None, "no media") if m is None else next(got) for m in media]


def _read_one(raw: bytes) -> tuple:
    try:
        return decode_streams([raw])[0], None
    except DAMAGE as e:
        return None, str(e) if isinstance(e, FlacError) else f"the stream is damaged: {e}"


#: What reading a damaged stream may raise.
DAMAGE = (ValueError, IndexError, OverflowError, struct.error)


# --- operators ----------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = utf8(text)
    return len(raw), raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def _grouped(rows: Iterator[tuple], size_of) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += size_of(row)
        if size >= TOGETHER:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame) -> DataFrame:
    """A stream for every text's UTF-8 bytes, padded with zeros: doc_id, n_bytes (unpadded), media.

    Null texts count as empty and give one block of padding; other columns are left out.
    """

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for block in _grouped(rows, lambda r: len(r[1] or "")):
            made = [payload_of(text) for _, text in block]
            for (doc_id, _), (n, _), media in zip(block, made, encode_streams([p for _, p in made]), strict=True):
                yield doc_id, n, media

    return per_row(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary", run)


def decode_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks of every stream: doc_id, block, sample_offset, n_samples, channels, bits, pcm, error.

    A block is a frame's samples, interleaved, little-endian in whole bytes; a reader seeks by
    sample_offset. Null media and a damaged stream give one row with an error and nothing else.
    Repeated rows are decoded each.
    """

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for block in _grouped(rows, lambda r: len(r[1] or b"")):
            for (doc_id, _), (read, error) in zip(block, read_streams([m for _, m in block]), strict=True):
                if read is None:
                    yield doc_id, None, None, None, None, None, None, error
                    continue
                info = read[0]
                for b, at, n, pcm in pcm_blocks(*read):
                    yield doc_id, b, at, n, info["channels"], info["bps"], pcm, None

    return per_row(media, ["doc_id", "media"], "doc_id long, block int, sample_offset long, n_samples long, channels int, bits int, pcm binary, error string", run)


def seek(blocks: DataFrame, first: int, count: int) -> DataFrame:
    """The blocks that hold any of ``count`` samples from ``first`` on."""
    return blocks.where((blocks.sample_offset < first + count) & (blocks.sample_offset + blocks.n_samples > first))


def features(pcm: np.ndarray) -> str:
    """Whole-number features of 8-bit samples: peak, energy, zero crossings, sum of absolute steps."""
    pcm = pcm.astype(np.int64)
    step = np.diff(pcm)
    return f"peak={int(np.abs(pcm).max())} energy={int((pcm * pcm).sum())} crossings={int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())} steps={int(np.abs(step).sum())}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks int, error string"


def digests(media: DataFrame) -> DataFrame:
    """Digests of the PCM blocks that each stored 8-bit mono stream decodes to; ``media`` needs doc_id, n_bytes, media.

    The payload is put together from the blocks at their sample offsets, which must leave no gap.
    Null media and damaged streams have an error, and null where there is nothing to digest.
    Repeated rows have a row each.
    """

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for block in _grouped(rows, lambda r: len(r[2] or b"")):
            for (doc_id, n, raw), (read, error) in zip(block, read_streams([m for _, _, m in block]), strict=True):
                stored = (None, None) if raw is None else (len(raw), hashlib.sha256(raw).hexdigest())
                if read is None:
                    yield doc_id, n, None, None, None, *stored, None, None, error
                    continue
                payload, n_blocks = bytearray(), 0
                for _, at, _, pcm in pcm_blocks(*read):
                    if at != len(payload):
                        raise FlacError("blocks leave a gap")
                    payload += pcm
                    n_blocks += 1
                payload = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
                yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), *stored, features(read[1][0]), n_blocks, None

    return per_row(media, ["doc_id", "n_bytes", "media"], DIGEST, run)


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(documents(spark, sf_dir)))
