"""Block codecs: decompressors for on-disk frames, and compressors for fixtures.

All are pure functions on bytes, used inside Arrow functions over blocks of bounded size.
"""

from __future__ import annotations

import gzip
import struct
import zlib


class CodecError(ValueError):
    """The frame is damaged or not of this codec."""


def lz4_block(data: bytes, size: int) -> bytes:
    """Decodes one LZ4 block to at most `size` bytes."""
    out, at, end = bytearray(), 0, len(data)

    def length(base: int) -> int:
        nonlocal at
        if base == 15:
            while True:
                if at >= end:
                    raise CodecError("length runs past the end")
                extra = data[at]
                at += 1
                base += extra
                if extra != 255:
                    break
        return base

    while at < end:
        token = data[at]
        at += 1
        literals = length(token >> 4)
        if at + literals > end or len(out) + literals > size:
            raise CodecError("literals run past the end")
        out += data[at : at + literals]
        at += literals
        if at == end:
            break
        if at + 2 > end:
            raise CodecError("offset is cut off")
        distance = data[at] | data[at + 1] << 8
        at += 2
        matched = length(token & 15) + 4
        start = len(out) - distance
        if distance == 0 or start < 0 or len(out) + matched > size:
            raise CodecError("match out of range")
        while matched > 0:
            piece = out[start : start + min(matched, distance)]
            out += piece
            start += len(piece)
            matched -= len(piece)
    return bytes(out)


def lz4_literal(data: bytes) -> bytes:
    """A valid LZ4 block that holds data as literals."""
    n, head = len(data), bytearray()
    head.append(min(n, 15) << 4)
    if n >= 15:
        left = n - 15
        while left >= 255:
            head.append(255)
            left -= 255
        head.append(left)
    return bytes(head) + data


def framed_lz4(data: bytes, size: int) -> bytes:
    """A block behind its big-endian length."""
    if len(data) < 4:
        raise CodecError("no length")
    n = struct.unpack(">I", data[:4])[0]
    if n > len(data) - 4:
        raise CodecError("length exceeds the frame")
    return lz4_block(data[4 : 4 + n], size)


def lzjb(data: bytes, size: int) -> bytes:
    """Decodes LZJB: each copy mask of 8 bits tells literals from (6-bit length, 10-bit distance) pairs."""
    out, at, mask, bit = bytearray(), 0, 0, 256
    while len(out) < size:
        if bit == 256:
            if at >= len(data):
                raise CodecError("copy mask is cut off")
            mask, bit, at = data[at], 1, at + 1
        if mask & bit:
            if at + 2 > len(data):
                raise CodecError("match is cut off")
            pair = data[at] << 8 | data[at + 1]
            at += 2
            distance = pair & 0x3FF
            if distance == 0 or distance > len(out):
                raise CodecError("match out of range")
            for _ in range((pair >> 10) + 3):
                if len(out) == size:
                    break
                out.append(out[-distance])
        else:
            if at >= len(data):
                raise CodecError("literal is cut off")
            out.append(data[at])
            at += 1
        bit <<= 1
    return bytes(out)


def zero_runs(data: bytes, size: int, level: int = 64) -> bytes:
    """Decodes zero-length encoding: n < level copies n + 1 bytes, else n - level + 1 zeros follow."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at] + 1
        at += 1
        if n <= level:
            out += data[at : at + n]
            at += n
        else:
            out += bytes(n - level)
    if len(out) != size:
        raise CodecError("size differs")
    return bytes(out)


def zstd_frame(data: bytes, size: int) -> bytes:
    """A Zstandard frame behind its big-endian length and a word of version and level; its magic number may be left out."""
    import zstandard

    n = struct.unpack(">I", data[:4])[0]
    body = data[8 : 8 + n]
    kind = zstandard.FORMAT_ZSTD1 if body[:4] == b"\x28\xb5\x2f\xfd" else zstandard.FORMAT_ZSTD1_MAGICLESS
    try:
        return zstandard.ZstdDecompressor(format=kind).decompress(body, max_output_size=size)
    except zstandard.ZstdError as e:
        raise CodecError(str(e)) from e


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise CodecError(str(e)) from e


def gunzip(data: bytes) -> bytes:
    return gzip.decompress(data)


#: Codes of on-disk compression (fixed values of the format): off is 2, gzip levels are 5 to 13.
LZJB, EMPTY, GZIP_FIRST, GZIP_LAST, ZLE, LZ4, ZSTD = 3, 4, 5, 13, 14, 15, 16


def decompress(code: int, data: bytes, size: int) -> bytes:
    """Data of a block by its compression code, exactly `size` bytes."""
    if code == LZJB:
        out = lzjb(data, size)
    elif code == EMPTY:
        out = bytes(size)
    elif GZIP_FIRST <= code <= GZIP_LAST:
        out = inflate(data, size)
    elif code == ZLE:
        out = zero_runs(data, size)
    elif code == LZ4:
        out = framed_lz4(data, size)
    elif code == ZSTD:
        out = zstd_frame(data, size)
    elif code in (0, 2):
        out = data[:size]
    else:
        raise CodecError(f"unknown compression {code}")
    if len(out) != size:
        raise CodecError(f"{len(out)} bytes instead of {size}")
    return out
