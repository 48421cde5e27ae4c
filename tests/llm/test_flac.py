import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmere.llm import flac


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5))
def test_round_trip(payloads):
    padded = [flac.padded(p) for p in payloads]
    assert all(len(p) % 192 == 0 and len(p) > 0 for p in padded)
    streams = flac.encode_many(padded)
    assert [(s + 128).astype(np.uint8).tobytes() for s in flac.decode_many(streams)] == padded
    assert [flac.encode_many([p])[0] for p in padded] == streams  # a stream doesn't depend on its neighbours


def test_long_signal_with_many_frames_and_seeking():
    data = flac.padded(bytes(range(256)) * 3000)
    stream = flac.encode_many([data])[0]
    assert (flac.decode_many([stream])[0] + 128).astype(np.uint8).tobytes() == data
    for first, count in ((0, 10), (12287, 3), (12288, 1), (500_000, 4000), (len(data) - 5, 50), (len(data), 4), (7, 0)):
        assert (flac.read_at(stream, first, count) + 128).astype(np.uint8).tobytes() == data[first : first + count]


def test_parts_of_a_long_signal_make_the_same_stream(monkeypatch):
    payloads = [flac.padded(bytes(range(256)) * n) for n in (30, 1, 9)]
    whole = flac.encode_many(payloads)
    monkeypatch.setattr(flac, "CHUNK", 7)
    assert flac.encode_many(payloads) == whole
    assert [(s + 128).astype(np.uint8).tobytes() for s in flac.decode_many(whole)] == payloads


def test_every_damaged_byte_is_found():
    stream = flac.encode_many([flac.padded(b"The quick brown fox jumps over the lazy dog. " * 12)])[0]
    start = flac.Stream(stream).start
    for at in [26, *range(start, len(stream), 7)]:
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_many([bytes(bad)])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]
        return self

    def data(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def crc(data, width, polynomial):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ polynomial if value >> (width - 1) & 1 else value << 1) & ((1 << width) - 1)
    return value


def stream_of(samples, subframe, bits=8, block=None):
    """A one-frame stream around the bits of a subframe, written by hand."""
    n = len(samples)
    code = bytes([0xFF, 0xF8, 0x70, {8: 0x02, 16: 0x08}[bits], 0x00]) + (n - 1).to_bytes(2, "big")
    frame = code + bytes([crc(code, 8, 0x07)])
    body = Bits()
    subframe(body)
    frame += body.data()
    frame += crc(frame, 16, 0x8005).to_bytes(2, "big")
    md5 = hashlib.md5(np.array(samples, "<i1" if bits == 8 else "<i2").tobytes()).digest()
    packed = 8000 << 44 | (bits - 1) << 36 | n
    info = n.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + md5
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + frame


def rice(b, values, k):
    for v in values:
        u = v * 2 if v >= 0 else -v * 2 - 1
        b.put(1, (u >> k) + 1).put(u & ((1 << k) - 1), k)


def test_subframes_that_the_encoder_does_not_write():
    x = [3, 5, 4, -7, 100, -100, 2, 0]
    constant = stream_of([9] * 8, lambda b: b.put(0, 8).put(9, 8))
    verbatim = stream_of(x, lambda b: b.put(2, 8) and [b.put(v & 255, 8) for v in x])

    def fixed2(b):
        b.put((8 + 2) << 1, 8).put(x[0] & 255, 8).put(x[1] & 255, 8).put(0, 2).put(1, 4)  # two partitions of four
        r = [x[t] - 2 * x[t - 1] + x[t - 2] for t in range(2, 8)]
        b.put(5, 4)
        rice(b, r[:2], 5)
        b.put(15, 4).put(11, 5)  # the second is escaped
        for v in r[2:]:
            b.put(v & 0x7FF, 11)

    def linear1(b):  # a long unary code: k = 0
        b.put(32 << 1, 8).put(x[0] & 255, 8).put(4, 4).put(1, 5).put(2, 5).put(0, 6).put(0, 4)
        rice(b, [x[t] - x[t - 1] for t in range(1, 8)], 0)

    def wide(b):
        y = [30000, -30000, 12345, 0, 1, -1, 7, 8]
        b.put(8 << 1, 8).put(1, 2).put(0, 4).put(20, 5)
        rice(b, y, 20)

    for stream, want in ((constant, [9] * 8), (verbatim, x), (stream_of(x, fixed2), x), (stream_of(x, linear1), x), (stream_of([30000, -30000, 12345, 0, 1, -1, 7, 8], wide, 16), [30000, -30000, 12345, 0, 1, -1, 7, 8])):
        assert flac.decode_many([stream])[0].tolist() == want


def test_odd_rows(spark, odd_docs, no_docs):
    decoded = flac.decode_column(flac.encode_column(odd_docs))
    rows = flac.digests(decoded).collect()
    want = []
    for r in odd_docs.collect():
        data = (r["text"] or "").encode()
        p = flac.padded(data)
        want.append((r["doc_id"], len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by_payload = {}
    for r in rows:
        by_payload.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())
    assert flac.decode_column(flac.encode_column(no_docs)).count() == 0
    blocks = flac.pcm_blocks(decoded.filter("doc_id = 8"), 1000).orderBy("sample_offset").collect()
    assert [b["sample_offset"] for b in blocks] == list(range(0, 300_096, 1000))
    assert b"".join(bytes(b["pcm"]) for b in blocks) == flac.padded(b"word " * 60_000)
