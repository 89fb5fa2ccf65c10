from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from palimpsest.errors import CorruptChain
from palimpsest.functions import codec

blob = st.binary(max_size=400)


@settings(max_examples=300, deadline=None)
@given(blob, blob, blob, st.sampled_from([0, 1, 2, 14, 15, 16, 300, 65_535]), st.booleans())
def test_round_trip(prefix, middle, suffix, tag, zstd):
    base, value = prefix + suffix, prefix + middle + suffix
    made = codec.encode(tag, base, value, zstd)
    assert codec.tag_of(made) == tag
    assert codec.decode(base, made) == value


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=16, max_size=64), max_size=12), st.randoms(), st.booleans())
def test_moved_blocks(parts, random, zstd):
    base = b"".join(parts)
    random.shuffle(parts)
    value = b"".join(parts)
    assert codec.decode(base, codec.encode(1, base, value, zstd)) == value


def test_sizes():
    import os

    base = os.urandom(20_000)
    value = base[:9000] + b"edit" + base[9100:]
    assert len(codec.encode(1, base, value)) < 20
    assert len(codec.encode(0, b"", b"a" * 10_000)) < 100
    moved = base[10_000:] + base[:10_000]
    assert len(codec.encode(1, base, moved, False)) < 10_100 and len(codec.encode(1, base, moved, True)) < 200


@pytest.mark.parametrize("bad", [b"", b"\x2f\xff", bytes([codec.SPLICE << 4 | 1, 200, 1, 200, 1]), bytes([15 << 4 | 1]), bytes([codec.PACKED << 4]) + b"xx"])
def test_damage(bad):
    with pytest.raises(CorruptChain):
        codec.decode(b"base", bad)


def test_no_base():
    with pytest.raises(CorruptChain):
        codec.decode(None, codec.encode(1, b"abc", b"abd"))


def test_tag_bounds():
    for tag in (-1, 65_536):
        with pytest.raises(ValueError):
            codec.encode_delta(tag, b"", b"")
