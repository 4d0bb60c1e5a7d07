"""Streams as other encoders write them: no or sparse seek tables, two channels, other block-size codes."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from marketlens.llm import flac


def wave(n: int, seed: int = 1) -> np.ndarray:
    return (90 * np.sin(np.arange(n) / 9)).astype(np.int64) + np.random.default_rng(seed).integers(-9, 9, n)


def without_table(stream: bytes, longest: bool = True) -> bytes:
    info = bytearray(stream[8:42])
    if not longest:
        info[7:10] = bytes(3)
    size = int.from_bytes(stream[43:46], "big")
    return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + bytes(info) + stream[46 + size :]


@pytest.mark.parametrize("longest", [True, False])
def test_streams_without_a_seek_table(longest):
    x = wave(1000)
    blocks = flac.decode(without_table(flac.encode(x, block=256), longest))[1]
    assert [at for at, _ in blocks] == [0, 256, 512, 768] and (np.concatenate([b for _, b in blocks]) == x).all()


def test_placeholder_seek_points():
    x = wave(1000)
    stream = flac.encode(x, block=256)
    stream = stream[:46] + b"\xff" * 8 + bytes(10) + stream[64:]
    assert (np.concatenate([b for _, b in flac.decode(stream)[1]]) == x).all()


@pytest.mark.parametrize("code", [1, 8, 9, 10])
def test_two_channels_and_block_codes(code):
    left, right = wave(192), wave(192, 2)
    pair = {1: ((left, 8), (right, 8)), 8: ((left, 8), (left - right, 9)), 9: ((left - right, 9), (right, 8)), 10: (((left + right) >> 1, 8), (left - right, 9))}[code]
    head = bytes([0xFF, 0xF8, 0x10, code << 4 | 2, 0])  # 192 samples by code
    head += bytes([flac.crc8(head)])
    frame = head + np.packbits(np.concatenate([flac._subframe(x, w, None) for x, w in pair])).tobytes()
    frame += flac.crc16(frame).to_bytes(2, "big")
    both = np.stack([left, right], axis=1)
    facts = (8000 << 44) | (1 << 41) | (7 << 36) | 192
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + facts.to_bytes(8, "big") + hashlib.md5(both.astype("i1").tobytes()).digest()
    ((at, found),) = flac.decode(b"fLaC\x80" + (34).to_bytes(3, "big") + info + frame)[1]
    assert at == 0 and (found == both).all()


def test_every_damaged_byte_of_a_frame_is_found():
    stream = without_table(flac.encode(wave(200), block=100))
    for k in range(42, len(stream)):
        broken = bytearray(stream)
        broken[k] ^= 0x10
        with pytest.raises(flac.FlacError):
            flac.decode(bytes(broken))
