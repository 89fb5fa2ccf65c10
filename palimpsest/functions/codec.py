"""Encoding of one value as a keyframe or as a delta against an earlier value.

A blob is a header byte - format in the high four bits, tag in the low four, 15 announcing a varint - and a body.
Tag 0 is a keyframe; tag n has the value n sequence numbers back as its base.  Nothing here knows Spark.
"""

from __future__ import annotations

import zlib

from ..errors import CorruptChain

try:
    import zstandard
except ImportError:  # the same formats, with zlib for the compressed bodies
    zstandard = None

RAW, PACKED, SPLICE, PACKED_DELTA, COPIES = range(5)
MAX_TAG = 65_535
LEVEL, _BLOCK = 3, 16
#: A splice whose own bytes are no more than this (or a sixteenth of the value) is not tried against anything else.
_SMALL = 48

if zstandard:
    _pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False)
    _unpack = zstandard.ZstdDecompressor()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise CorruptChain("delta ends inside a number")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _header(kind: int, tag: int) -> bytes:
    return bytes([kind << 4 | tag]) if tag < 15 else bytes([kind << 4 | 15]) + _varint(tag - 15)


def _read_header(blob: bytes) -> tuple[int, int, int]:
    if not blob:
        raise CorruptChain("failed to extract tag: empty delta")
    kind, tag = blob[0] >> 4, blob[0] & 15
    if tag < 15:
        return kind, tag, 1
    more, at = _read_varint(blob, 1)
    return kind, 15 + more, at


def tag_of(blob: bytes) -> int:
    return _read_header(blob)[1]


def _compress(value: bytes, base: bytes | None) -> bytes:
    if zstandard is None:
        pack = zlib.compressobj(6, zlib.DEFLATED, -15, zdict=base[-32768:]) if base else zlib.compressobj(6, zlib.DEFLATED, -15)
        return pack.compress(value) + pack.flush()
    if not base:
        return _pack.compress(value)
    known = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    window = max(10, min(27, (len(base) + len(value)).bit_length()))
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=window, write_content_size=True)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress(value)


def _decompress(body: bytes, base: bytes | None) -> bytes:
    try:
        if zstandard is None:
            unpack = zlib.decompressobj(-15, zdict=base[-32768:]) if base else zlib.decompressobj(-15)
            return unpack.decompress(body) + unpack.flush()
        if not base:
            return _unpack.decompress(body)
        known = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdDecompressor(dict_data=known, max_window_size=1 << 27).decompress(body)
    except Exception as e:
        raise CorruptChain(f"delta cannot be decoded: {e}") from e


def common_prefix(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    low, step = 0, 64
    while low < most and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    if low >= most:
        return most
    high = min(low + step, most)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def common_suffix(a: bytes, b: bytes, most: int) -> int:
    low, step, n, m = 0, 64, len(a), len(b)
    while low < most and a[max(n - low - step, n - most) : n - low] == b[max(m - low - step, m - most) : m - low]:
        low += step
        step *= 2
    if low >= most:
        return most
    high = min(low + step, most)
    while low < high:
        mid = (low + high + 1) // 2
        if a[n - mid : n - low] == b[m - mid : m - low]:
            low = mid
        else:
            high = mid - 1
    return low


def _copies(base: bytes, value: bytes) -> bytes:
    """Runs of the base found by the hash of their first block, and literals between them."""
    table: dict[bytes, int] = {}
    for i in range(0, len(base) - _BLOCK + 1, _BLOCK):
        table.setdefault(base[i : i + _BLOCK], i)
    out, literal, at = bytearray(), 0, 0
    while at < len(value):
        found = table.get(value[at : at + _BLOCK]) if at + _BLOCK <= len(value) else None
        if found is None:
            at += 1
            continue
        size = common_prefix(base[found:], value[at:])
        out += _varint(at - literal) + value[literal:at] + _varint(found) + _varint(size)
        at += size
        literal = at
    return bytes(out + _varint(len(value) - literal) + value[literal:])


def _apply_copies(body: bytes, base: bytes) -> bytes:
    out, at = bytearray(), 0
    while True:
        n, at = _read_varint(body, at)
        out += body[at : at + n]
        at += n
        if at >= len(body):
            return bytes(out)
        start, at = _read_varint(body, at)
        size, at = _read_varint(body, at)
        out += base[start : start + size]


def encode_keyframe(value: bytes, zstd: bool = True) -> bytes:
    if zstd and len(value) > 32:
        body = _compress(value, None)
        if len(body) < len(value):
            return _header(PACKED, 0) + body
    return _header(RAW, 0) + value


def encode_delta(tag: int, base: bytes, value: bytes, zstd: bool = True) -> bytes:
    if not 0 < tag <= MAX_TAG:
        raise ValueError(f"a delta's tag is 1 to {MAX_TAG}, not {tag}")
    prefix = common_prefix(base, value)
    suffix = common_suffix(base, value, min(len(base), len(value)) - prefix)
    middle = value[prefix : len(value) - suffix]
    body, kind = _varint(prefix) + _varint(suffix) + middle, SPLICE
    if len(middle) > max(_SMALL, len(value) >> 4):
        other = _compress(value, base) if zstd else _copies(base, value) if base else body
        if len(other) < len(body):
            body, kind = other, PACKED_DELTA if zstd else COPIES
    return _header(kind, tag) + body


def encode(tag: int, base: bytes, value: bytes, zstd: bool = True) -> bytes:
    """``value`` as a keyframe (tag 0) or against ``base``."""
    return encode_delta(tag, base, value, zstd) if tag else encode_keyframe(value, zstd)


def decode(base: bytes | None, blob: bytes) -> bytes:
    kind, tag, at = _read_header(blob)
    body = blob[at:]
    if kind == RAW:
        return body
    if kind == PACKED:
        return _decompress(body, None)
    if not tag or base is None:
        raise CorruptChain("a delta has no base")
    if kind == SPLICE:
        prefix, i = _read_varint(body, 0)
        suffix, i = _read_varint(body, i)
        if prefix + suffix > len(base):
            raise CorruptChain("a delta does not fit its base")
        return base[:prefix] + body[i:] + (base[len(base) - suffix :] if suffix else b"")
    if kind == PACKED_DELTA:
        return _decompress(body, base)
    if kind == COPIES:
        return _apply_copies(body, base)
    raise CorruptChain(f"unknown delta format {kind}")
