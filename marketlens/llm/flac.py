"""A FLAC codec in numpy: frames with constant, verbatim, fixed and linear predictors; the encoder takes mono samples.

The encoder takes the cheapest of a constant, verbatim samples and the fixed predictors with Rice-coded
residuals (and a linear predictor if given coefficients).  The decoder reads all subframe types,
partitioned Rice residuals with escapes, 4 or 5 bit parameters and wasted bits, and verifies the checksum
of each frame's header and body and the MD5 of the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np

_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """The stream is damaged or uses what this decoder does not read."""


def _crc_table(poly: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        table = np.where(table >> (width - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << width) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Row d: what a byte contributes to the CRC-16 if d bytes follow it; grows as needed.
_far = _CRC16[None, :].astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: bytes) -> int:
    """Both checksums start at 0, so they are sums over GF(2) of what each byte contributes at its distance."""
    global _far
    b = np.frombuffer(data, dtype=np.uint8)[::-1]
    while len(_far) < min(len(b), 1 << 14):
        last = _far[-1].astype(np.int64)
        step = [((last << 8) & 0xFFFF) ^ _CRC16[last >> 8]]
        for _ in range(511):
            step.append(((step[-1] << 8) & 0xFFFF) ^ _CRC16[step[-1] >> 8])
        _far = np.vstack([_far, np.array(step, dtype=np.uint16)])
    if len(b) <= len(_far):
        return int(np.bitwise_xor.reduce(_far[np.arange(len(b)), b])) if len(b) else 0
    c = 0
    for x in data:
        c = ((c << 8) & 0xFFFF) ^ int(_CRC16[(c >> 8) ^ x])
    return c


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    k = 0
    while n >= 1 << (6 - k):
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        k += 1
    return bytes([((0xFF << (7 - k)) & 0xFF) | n, *reversed(tail)])


def _bits(value: int, width: int) -> np.ndarray:
    return np.array([(value >> (width - 1 - i)) & 1 for i in range(width)], dtype=np.uint8)


def _spread(values: np.ndarray, width: int) -> np.ndarray:
    """Each value's lowest ``width`` bits, one after another."""
    return ((values[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1)


def _residual(x: np.ndarray, coefficients: tuple[int, ...], shift: int = 0) -> np.ndarray:
    k = len(coefficients)
    if not k:
        return x
    guess = np.zeros(len(x) - k, dtype=np.int64)
    for i, c in enumerate(coefficients):
        guess += c * x[k - 1 - i : len(x) - 1 - i]
    return x[k:] - (guess >> shift)


def _rice_cost(u: np.ndarray) -> tuple[int, int]:
    """Fewest bits and the parameter, for residuals folded to unsigned."""
    mean = max(1, int(u.sum()) // max(1, len(u)))
    middle = max(0, mean.bit_length() - 1)
    return min((len(u) * (k + 1) + int((u >> k).sum()), k) for k in range(max(0, middle - 1), min(14, middle + 1) + 1))


def _rice_bits(u: np.ndarray, k: int) -> np.ndarray:
    ends = np.cumsum((u >> k) + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    bits[ends - k - 1] = 1
    for j in range(k):
        bits[ends - k + j] = (u >> (k - 1 - j)) & 1
    return bits


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 63)


def _subframe(x: np.ndarray, width: int, predictor: tuple[tuple[int, ...], int, int] | None) -> np.ndarray:
    if (x == x[0]).all():
        return np.concatenate([_bits(0, 8), _spread(x[:1], width)])
    sums = []
    r = x
    for k in range(5):
        if len(x) > k:
            sums.append((int(np.abs(r).sum()), k))
        r = np.diff(r)
    order = min(sums)[1]
    u = _fold(_residual(x, _FIXED[order]))
    cost, k = _rice_cost(u)
    best = (8 + order * width + 10 + cost, "fixed")
    if predictor:
        coefficients, shift, precision = predictor
        lu = _fold(_residual(x, coefficients, shift))
        lcost, lk = _rice_cost(lu)
        best = min(best, (8 + len(coefficients) * (width + precision) + 19 + lcost, "linear"))
    if best[0] >= 8 + len(x) * width:
        return np.concatenate([_bits(1 << 1, 8), _spread(x, width)])
    if best[1] == "linear":
        head = [_bits((0x20 | (len(coefficients) - 1)) << 1, 8), _spread(x[: len(coefficients)], width), _bits(precision - 1, 4), _bits(shift, 5), _spread(np.array(coefficients), precision)]
        return np.concatenate([*head, _bits(0, 6), _bits(lk, 4), _rice_bits(lu, lk)])
    return np.concatenate([_bits((8 | order) << 1, 8), _spread(x[:order], width), _bits(0, 6), _bits(k, 4), _rice_bits(u, k)])


def encode(samples: np.ndarray, width: int = 8, rate: int = 8000, block: int = 4096, predictor: tuple[tuple[int, ...], int, int] | None = None) -> bytes:
    """A mono stream of signed ``samples``; ``predictor`` is (coefficients, shift, precision), tried on each frame."""
    if width not in (8, 16):
        raise ValueError("samples have 8 or 16 bits")
    samples = samples.astype(np.int64)
    frames, points = [], []
    at = 0
    for n, start in enumerate(range(0, len(samples), block)):
        x = samples[start : start + block]
        head = bytes([0xFF, 0xF8, 0x70, 0x02 if width == 8 else 0x08]) + _number(n) + (len(x) - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        usable = predictor if predictor and len(x) > len(predictor[0]) else None
        body = head + np.packbits(_subframe(x, width, usable)).tobytes()
        frames.append(body + crc16(body).to_bytes(2, "big"))
        points.append(start.to_bytes(8, "big") + at.to_bytes(8, "big") + len(x).to_bytes(2, "big"))
        at += len(frames[-1])
    sizes = [len(f) for f in frames] or [0]
    md5 = hashlib.md5(samples.astype("<i2" if width == 16 else "i1").tobytes()).digest()
    packed = (rate << 44) | (0 << 41) | ((width - 1) << 36) | len(samples)
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    table = b"".join(points)
    return b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *frames])


class _Reader:
    """Bits of one frame's subframe, with the ones among them for finding stop bits."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
        self.at = 0
        self._ones: np.ndarray | None = None

    def take(self, width: int) -> int:
        if self.at + width > len(self.bits):
            raise FlacError("the frame ends early")
        v = int.from_bytes(np.packbits(self.bits[self.at : self.at + width]).tobytes(), "big") >> (-width % 8)
        self.at += width
        return v

    def block(self, n: int, width: int, signed: bool = True) -> np.ndarray:
        if self.at + n * width > len(self.bits):
            raise FlacError("the frame ends early")
        b = self.bits[self.at : self.at + n * width].reshape(n, width)
        self.at += n * width
        v = np.zeros(n, dtype=np.int64)
        for i in range(width):
            v = (v << 1) | b[:, i]
        return v - ((v >> (width - 1)) << width) if signed and width else v

    def rice(self, n: int, k: int) -> np.ndarray:
        """n residuals: unary quotients up to a stop bit, then k bits each."""
        if not n:
            return np.zeros(0, dtype=np.int64)
        if self._ones is None:
            self._ones = np.flatnonzero(self.bits)
            self._before = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64), [0] * 40])
            self._before[len(self.bits) + 1 :] = len(self._ones)
        begin = int(self._before[self.at])
        ones = self._ones
        # The stop bit after each one, if that one is a stop bit itself; then follow them from the first.
        follow = self._before[ones + (1 + k)].tolist()
        chain, p, m = [], begin, len(ones)
        for _ in range(n):
            if p >= m:
                raise FlacError("the frame ends early")
            chain.append(p)
            p = follow[p]
        stops = ones[chain]
        starts = np.empty(n, dtype=np.int64)
        starts[0] = self.at
        starts[1:] = stops[:-1] + 1 + k
        u = stops - starts
        if stops[-1] + k >= len(self.bits):
            raise FlacError("the frame ends early")
        for j in range(k):
            u = (u << 1) | self.bits[stops + 1 + j]
        self.at = int(stops[-1]) + 1 + k
        return (u >> 1) ^ -(u & 1)


def _read_residual(r: _Reader, n: int, order: int) -> np.ndarray:
    method = r.take(2)
    if method > 1:
        raise FlacError("unknown residual coding")
    width, escape = (4, 15) if method == 0 else (5, 31)
    parts = 1 << r.take(4)
    if n % parts or n // parts < order:
        raise FlacError("partitions do not fit the block")
    out = []
    for i in range(parts):
        size = n // parts - (order if i == 0 else 0)
        k = r.take(width)
        out.append(r.rice(size, k) if k != escape else r.block(size, w) if (w := r.take(5)) else np.zeros(size, dtype=np.int64))
    return np.concatenate(out)


def _read_subframe(r: _Reader, n: int, width: int) -> np.ndarray:
    kind = r.take(8)
    if kind & 0x80:
        raise FlacError("no subframe begins here")
    wasted = 0
    if kind & 1:
        wasted = 1
        while not r.take(1):
            wasted += 1
    kind = (kind >> 1) & 0x3F
    width -= wasted
    if kind == 0:
        x = np.repeat(r.block(1, width), n)
    elif kind == 1:
        x = r.block(n, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = r.block(order, width)
        x = _read_residual(r, n, order)
        # The residual of order k is the k-th difference; sums undo it one order at a time.
        for k in range(order, 0, -1):
            first = np.diff(warm, n=k - 1)[:1] if k > 1 else warm[:1]
            ahead = np.diff(warm, n=k - 1)
            x = np.concatenate([ahead[: order - k + 1], ahead[order - k] + np.cumsum(x[order - k :])]) if len(ahead) else np.concatenate([first, first + np.cumsum(x)])
    elif kind >= 32:
        order = kind - 31
        warm = r.block(order, width).tolist()
        precision, shift = r.take(4) + 1, r.take(5)
        shift -= (shift >> 4) << 5
        if precision == 16 or shift < 0:
            raise FlacError("unknown predictor precision or shift")
        c = r.block(order, precision).tolist()
        res = _read_residual(r, n, order).tolist()
        out = warm
        for e in res:
            out.append(e + (sum(a * b for a, b in zip(c, reversed(out[-order:]))) >> shift))
        x = np.array(out, dtype=np.int64)
    else:
        raise FlacError("reserved subframe type")
    return x << wasted


def _frame_header(b: bytes, width: int) -> tuple[int, int, int, int]:
    """Samples, channel code, bits of a sample and bytes of the header at the front of ``b``, its checksum included."""
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8 or b[3] & 1:
        raise FlacError("no frame begins here")
    size, rate, channels, depth = b[2] >> 4, b[2] & 15, b[3] >> 4, (b[3] >> 1) & 7
    lead = b[4]
    at = 5 + (0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length())
    stored = {6: 1, 7: 2}.get(size, 0)
    if size == 0 or rate == 15 or channels > 10 or depth == 3 or len(b) <= at + stored + 2:
        raise FlacError("a frame header has a reserved code or ends early")
    if stored:
        n = int.from_bytes(b[at : at + stored], "big") + 1
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    at += stored + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(b[:at]) != b[at]:
        raise FlacError("a frame header's checksum differs")
    return n, channels, (width, 8, 12, 0, 16, 20, 24, 32)[depth], at + 1


def _read_channels(r: _Reader, n: int, code: int, width: int) -> np.ndarray:
    """Samples of one frame: a vector of a mono one, else a row for each sample."""
    if code < 8:
        found = [_read_subframe(r, n, width) for _ in range(code + 1)]
        return found[0] if code == 0 else np.stack(found, axis=1)
    a, b = _read_subframe(r, n, width + (code == 9)), _read_subframe(r, n, width + (code != 9))
    if code == 8:  # left, difference
        return np.stack([a, a - b], axis=1)
    if code == 9:  # difference, right
        return np.stack([a + b, b], axis=1)
    middle = (a << 1) | (b & 1)
    return np.stack([(middle + b) >> 1, (middle - b) >> 1], axis=1)


def decode(stream: bytes) -> tuple[dict, list[tuple[int, np.ndarray]]]:
    """Stream facts, and ``(sample offset, samples)`` of each frame.

    A frame ends where its last subframe does, so a seek table is not needed: one that is sparse, or has placeholders, or is missing does
    not matter.  Where the facts name no longest frame, one is taken to be at most twice as long as its samples stored as they are.
    """
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info = 4, None
    while True:
        if at + 4 > len(stream):
            raise FlacError("the stream ends early")
        head, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if head & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "longest": int.from_bytes(body[7:10], "big"), "rate": packed >> 44, "channels": ((packed >> 41) & 7) + 1}
            info |= {"width": ((packed >> 36) & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        at += 4 + size
        if head & 0x80:
            break
    if info is None:
        raise FlacError("no stream facts")
    blocks, offset, md5 = [], 0, hashlib.md5()
    bytes_each = -(-info["width"] // 8)
    while at < len(stream):
        n, code, width, head = _frame_header(stream[at : at + 16], info["width"])
        longest = info["longest"] or 64 + 2 * info["channels"] * n * (width + 1) // 8
        frame = stream[at : at + longest]
        r = _Reader(frame[head:-2])
        try:
            x = _read_channels(r, n, code, width)
        except (IndexError, OverflowError) as damage:
            raise FlacError("a frame is damaged") from damage
        end = head + -(-r.at // 8)
        if crc16(frame[:end]) != int.from_bytes(frame[end : end + 2], "big"):
            raise FlacError("a frame's checksum differs")
        blocks.append((offset, x))
        md5.update(x.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :bytes_each].tobytes())
        offset, at = offset + n, at + end + 2
    if info["samples"] and offset != info["samples"] or any(info["md5"]) and md5.digest() != info["md5"]:
        raise FlacError("the decoded samples differ from the stream's facts")
    return info, blocks
