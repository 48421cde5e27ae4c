"""Media columns: FLAC streams of 8-bit mono samples, encoded and decoded for many rows at a time.

The encoder writes frames of 192 samples, each with the cheaper of a first-order fixed predictor and a linear predictor
of order 4 whose coefficients are fitted on the row's whole signal, and Rice-coded residuals. It adds STREAMINFO with
the signal's MD5, and a SEEKTABLE. The decoder finds the frames by their sync codes and header checksums, verifies each
frame's CRC-16, decodes Rice partitions, escapes, constant, verbatim, fixed and linear subframes of all frames of a slice
side by side, and checks length and MD5. Frames' sample numbers give seekable offsets: pcm_blocks() yields the samples
as blocks with their offsets, read_at() decodes only the frames that a range of samples needs.

A null payload is an empty one. The query's payloads are texts padded with spaces to a positive multiple of 192 bytes.
A damaged stream raises ValueError, naming the checksum that fails. Equal payloads give equal streams. Streams of more
channels or of over 16 bits a sample are not taken. Repeated rows give repeated rows; an empty table an empty table.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

FRAME, RATE, ORDER, PRECISION, SHIFT = 192, 8000, 4, 10, 8
#: Frames between two points of the seek table.
SEEK_FRAMES = 64
#: Payload bytes that are coded side by side.
SIDE_BY_SIDE = 1 << 20
#: Frames that are coded side by side: a longer signal is coded in several parts, with the same result.
CHUNK = 8192
#: Predictors of the fixed subframes, as coefficients of the samples before: fixed values of the format.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(width: int, polynomial: int) -> np.ndarray:
    table, high, mask = np.arange(256, dtype=np.uint32) << (width - 8), 1 << (width - 1), (1 << width) - 1
    for _ in range(8):
        table = np.where(table & high, (table << 1) ^ polynomial, table << 1) & mask
    return table.astype(np.uint32)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
#: Leading zeros of 16-bit numbers.
ZEROS = np.array([16 - x.bit_length() for x in range(1 << 16)], np.int64)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, a byte of each at a time."""
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], -lengths[order]
    crc = np.zeros(len(starts), np.uint32)
    for t in range(-int(sizes[0]) if len(sizes) else 0):
        n = np.searchsorted(sizes, -t)
        part = crc[:n]
        crc[:n] = ((part << 8) & 0xFFFF) ^ CRC16[(part >> 8) ^ data[starts[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def utf8_number(number: int) -> bytes:
    """A frame number in the format's extended UTF-8 (up to 36 bits)."""
    if number < 0x80:
        return bytes([number])
    more = next(n for n in range(1, 7) if number < 1 << (6 * n + max(0, 6 - n)))
    lead = (0xFF00 >> (more + 1)) & 0xFF
    return bytes([lead | number >> (6 * more)] + [0x80 | (number >> (6 * i)) & 0x3F for i in range(more - 1, -1, -1)])


def _signed(raw: np.ndarray) -> np.ndarray:
    return raw.astype(np.int32) - 128


def _predictors(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each row (frames raw[first[i]:first[i + 1]]): Levinson-Durbin on exact integer sums."""
    lagged = np.zeros((len(raw), ORDER + 1), np.int64)
    for a in range(0, len(raw), CHUNK):
        x = _signed(raw[a : a + CHUNK])
        for lag in range(ORDER + 1):
            lagged[a : a + CHUNK, lag] = (x[:, lag:] * x[:, : FRAME - lag]).sum(1, dtype=np.int64)
    r = np.add.reduceat(lagged, first).astype(float)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    a, error = np.zeros((len(r), ORDER + 1)), r[:, 0].copy()
    for i in range(1, ORDER + 1):
        acc = r[:, i].copy()
        for j in range(1, i):
            acc -= a[:, j] * r[:, i - j]
        k = acc / error
        new = a.copy()
        new[:, i] = k
        for j in range(1, i):
            new[:, j] = a[:, j] - k * a[:, i - j]
        a, error = new, error * (1 - k * k)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a[:, 1:] * (1 << SHIFT)), -most, most - 1).astype(np.int32)


def _folded(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-negative codes, the Rice parameter of each frame, and the bits that its codes take."""
    u = (residual << 1) ^ (residual >> 31)
    n, total = u.shape[1], u.sum(1, dtype=np.int64)
    k = np.zeros(len(u), np.int32)
    for p in range(1, 15):
        k += total >= (n << p)
    return u, k, n * (k + 1) + (u >> k[:, None]).sum(1, dtype=np.int64)


def _encode_frames(x: np.ndarray, coef: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of samples under each frame's coefficients and number, and their sizes."""
    total = len(x)
    predicted = sum(coef[:, j : j + 1] * x[:, ORDER - 1 - j : FRAME - 1 - j] for j in range(ORDER)) >> SHIFT
    linear, fixed = _folded(x[:, ORDER:] - predicted), _folded(x[:, 1:] - x[:, :-1])
    use = linear[2] + 8 * (ORDER - 1) + 9 + PRECISION * ORDER < fixed[2]
    digits = np.ones(total, np.int64)
    for n, bits in enumerate((7, 11, 16, 21, 26, 31), 1):
        digits[number >> bits > 0] = n + 1
    lead = 8 * (4 + digits + 1) + 8  # header and the subframe's first byte
    body = np.where(use, linear[2] + 8 * ORDER + 9 + PRECISION * ORDER, fixed[2] + 8) + 10
    size = (lead + body + 7) // 8 + 2
    end = np.cumsum(size)
    start = end - size
    bits = np.zeros(int(end[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray | int, width: int) -> np.ndarray:
        for i in range(width):
            bits[at + i] = (value >> (width - 1 - i)) & 1
        return at + width

    for count in np.unique(digits):
        for is_linear in (False, True):
            who = np.flatnonzero((digits == count) & (use == is_linear))
            if not len(who):
                continue
            tail = [0x80 | (number[who] >> (6 * i)) & 0x3F for i in range(count - 2, -1, -1)]
            head = [np.full(len(who), b) for b in (0xFF, 0xF8, 0x14, 0x02)]
            head += [number[who] if count == 1 else ((0xFF00 >> count) & 0xFF) | number[who] >> (6 * (count - 1)), *tail]
            crc = np.zeros(len(who), np.uint32)
            at = start[who] * 8
            for byte in head:
                crc = CRC8[crc ^ byte.astype(np.uint32)]
                at = put(at, byte, 8)
            at = put(at, crc, 8)
            order = ORDER if is_linear else 1
            at = put(at, 32 + ORDER - 1 << 1 if is_linear else 8 + 1 << 1, 8)
            for j in range(order):
                at = put(at, x[who, j] & 0xFF, 8)
            if is_linear:
                at = put(put(at, PRECISION - 1, 4), SHIFT, 5)
                for j in range(ORDER):
                    at = put(at, coef[who, j] & ((1 << PRECISION) - 1), PRECISION)
            codes, params, _ = linear if is_linear else fixed
            params = params[who]
            at = put(put(at, 0, 6), params, 4)
            for k in np.unique(params):
                some = np.flatnonzero(params == k)
                u = codes[who[some]]
                length = (u >> k) + (k + 1)
                stop = at[some, None] + np.cumsum(length, 1)
                bits[stop - (k + 1)] = 1
                for j in range(k):
                    bits[stop - (k - j)] = (u >> (k - 1 - j)) & 1
    data = np.packbits(bits)
    crc = crc16(data, start, size - 2)
    data[end - 2], data[end - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), size


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of FRAME."""
    frames = np.array([len(p) // FRAME for p in payloads])
    last = np.cumsum(frames)
    first, total = last - frames, int(last[-1])
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(total, FRAME)
    row = np.repeat(np.arange(len(payloads)), frames)
    number, coef = np.arange(total) - first[row], _predictors(raw, first)
    parts = [_encode_frames(_signed(raw[a : a + CHUNK]), coef[row[a : a + CHUNK]], number[a : a + CHUNK]) for a in range(0, total, CHUNK)]
    stream, size = b"".join(p for p, _ in parts), np.concatenate([n for _, n in parts])
    end = np.cumsum(size)
    start, out = end - size, []
    for i, payload in enumerate(payloads):
        a, b = int(first[i]), int(last[i])
        base = int(start[a])
        md5 = hashlib.md5((raw[a:b] ^ 0x80).tobytes()).digest()
        sizes = size[a:b]
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = struct.pack(">HH", FRAME, FRAME) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        seek = b"".join(struct.pack(">QQH", (f - a) * FRAME, int(start[f]) - base, FRAME) for f in range(a, b, SEEK_FRAMES))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + stream[base : int(end[b - 1])])
    return out


class Stream:
    """The metadata of a stream: where its frames begin, its length, sample size, MD5 and seek points."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points, info = 4, False, [], None
        while not last:
            if at + 4 > len(data):
                raise ValueError("the metadata are cut off")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                info = block
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != 2**64 - 1]
            at += 4 + size
        if info is None or len(info) != 34:
            raise ValueError("STREAMINFO is missing")
        packed = int.from_bytes(info[10:18], "big")
        self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        self.md5, self.start = info[18:34], at
        if self.channels != 1 or self.bits > 16:
            raise ValueError("only one channel of at most 16 bits is taken")


def _block_size(code: int, data: np.ndarray, at: int) -> tuple[int, int]:
    """Samples of a frame, and the bytes that its header takes for them."""
    if code == 1:
        return 192, 0
    if 2 <= code <= 5:
        return 576 << (code - 2), 0
    if code == 6:
        return int(data[at]) + 1, 1
    if code == 7:
        return (int(data[at]) << 8 | int(data[at + 1])) + 1, 2
    if code >= 8:
        return 256 << (code - 8), 0
    raise ValueError("reserved block size")


def find_frames(data: np.ndarray, start: int, stop: int) -> list[tuple[int, int, int, int]]:
    """(where, first byte after the header, frame number, samples) of all valid frame headers in data[start:stop]."""
    sync = np.flatnonzero((data[start : stop - 1] == 0xFF) & (data[start + 1 : stop] == 0xF8)) + start
    out = []
    extra_rate = {12: 1, 13: 2, 14: 2}
    for p in sync.tolist():
        if p + 6 > stop or data[p + 3] & 1 or data[p + 2] >> 4 == 0 or data[p + 2] & 15 == 15:
            continue
        lead = int(data[p + 4])
        more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
        if not 0 <= more <= 6 or more == 0 and lead >= 0x80 or p + 5 + more > stop:
            continue
        number = lead if not more else lead & ((1 << (6 - more)) - 1) if more < 6 else 0
        for i in range(more):
            number = number << 6 | int(data[p + 5 + i]) & 0x3F
        at = p + 5 + more
        samples, used = _block_size(int(data[p + 2]) >> 4, data, at) if at + 2 < stop else (0, 0)
        at += used + extra_rate.get(int(data[p + 2]) & 15, 0)
        if at >= stop:
            continue
        crc = 0
        for byte in data[p:at].tolist():
            crc = int(CRC8[crc ^ byte])
        if crc == data[at]:
            out.append((p, at + 1, number, samples))
    return out


def _chain(found: list[tuple[int, int, int, int]], data: np.ndarray, stop: int, number: int) -> list[tuple[int, int, int, int, int]]:
    """Frames in order, each with its end. A header that residuals happen to look like is found out by the CRC-16."""
    ends = [f[0] for f in found[1:]] + [stop]
    if [f[2] for f in found] == list(range(number, number + len(found))):
        return [(*f, e) for f, e in zip(found, ends)]
    out, i = [], 0
    while i < len(found):
        for j in range(i, len(found)):
            end = ends[j]
            if (j + 1 == len(found) or found[j + 1][2] == number + 1) and _sound(data, found[i][0], end):
                break
        else:
            raise ValueError(f"CRC-16 of frame {number} fails")
        out.append((*found[i], end))
        i, number = j + 1, number + 1
    return out


def _sound(data: np.ndarray, start: int, end: int) -> bool:
    crc = crc16(data, np.array([start]), np.array([end - start - 2]))[0]
    return end - start > 2 and int(crc) == int(data[end - 2]) << 8 | int(data[end - 1])


def decode_frames(data: np.ndarray, frames: list[tuple[int, int, int, int, int]], bits: int) -> np.ndarray:
    """Samples of frames, concatenated. data must have 8 bytes to spare after the last frame."""
    if len(frames) > CHUNK:
        return np.concatenate([decode_frames(data, frames[a : a + CHUNK], bits) for a in range(0, len(frames), CHUNK)])
    start, at, _, count, end = (np.array(c, np.int64) for c in zip(*frames))
    base = int(start[0])
    data, start, at, end = data[base : int(end[-1]) + 8], start - base, at - base, end - base
    crc = crc16(data, start, end - start - 2)
    if (wrong := crc != (data[end - 2].astype(np.uint32) << 8 | data[end - 1])).any():
        raise ValueError(f"CRC-16 of frame {frames[int(np.argmax(wrong))][2]} fails")
    wide = data.astype(np.uint32)
    window = (wide[:-4] << 24) | (wide[1:-3] << 16) | (wide[2:-2] << 8) | wide[3:-1]

    def peek(pos: np.ndarray) -> np.ndarray:
        return window[pos >> 3] << (pos & 7).astype(np.uint32)

    def take(pos: np.ndarray, width) -> np.ndarray:
        """Unsigned, of up to 24 bits."""
        return ((peek(pos) >> np.uint32(1)) >> (31 - np.asarray(width)).astype(np.uint32)).astype(np.int64)

    def signed(value: np.ndarray, width) -> np.ndarray:
        return value - ((value >> (width - 1) & 1) << width)

    kind = data[at].astype(np.int64)
    if (kind & 1).any():
        raise ValueError("wasted bits are not taken")
    kind >>= 1
    out = np.zeros(int(count.sum()), np.int32)
    place = np.cumsum(count) - count
    pos0 = (at + 1) * 8
    linear = (kind >= 8) & (kind <= 12) | (kind >= 32)
    order_of = np.where(kind >= 32, kind - 31, np.where(linear, kind - 8, 0))
    if (~linear & (kind > 1)).any():
        raise ValueError("reserved subframe")
    for k in np.unique(kind[~linear]):
        for i in np.flatnonzero(kind == k):
            where = pos0[i] + (bits * np.arange(count[i]) if k else np.zeros(count[i], np.int64))
            out[place[i] : place[i] + count[i]] = signed(take(where, bits), bits)
    # the group key: kind, samples and Rice partitions, so that all lanes of a group have the same layout
    skip = pos0 + bits * order_of
    precision = np.where(kind >= 32, take(skip, 4) + 1, 0)
    shift = np.where(kind >= 32, signed(take(skip + 4, 5), 5), 0)
    if (shift < 0).any():
        raise ValueError("a negative shift")
    coded = skip + np.where(kind >= 32, 9 + precision * order_of, 0)
    method, partition = take(coded, 2), take(coded + 2, 4)
    if (method[linear] > 1).any():
        raise ValueError("reserved residual coding")
    groups = np.stack([kind, count, partition, method], 1)
    groups[~linear] = -1
    for kind_, n, parts, width in np.unique(groups[linear], axis=0).tolist() if linear.any() else []:
        lane = np.flatnonzero((groups == [kind_, n, parts, width]).all(1))
        order, lanes = int(order_of[lane[0]]), len(lane)
        x = np.zeros((n, lanes), np.int64 if bits > 8 else np.int32)
        for t in range(order):
            x[t] = signed(take(pos0[lane] + bits * t, bits), bits)
        if kind_ >= 32:
            base, prec = skip[lane] + 9, precision[lane]
            coef = [signed(take(base + prec * j, prec), prec).astype(x.dtype) for j in range(order)]
        else:
            coef = [np.full(lanes, c, x.dtype) for c in FIXED[order]]
        down = shift[lane].astype(x.dtype)
        pos, field = coded[lane] + 6, 5 if width else 4
        each = n >> parts
        raw = None
        for t in range(order, n):
            if t == order or t % each == 0:
                k = take(pos, field)
                pos = pos + field
                escaped = k == (1 << field) - 1
                raw = None
                if escaped.any():
                    raw = np.where(escaped, take(pos, 5), 0)
                    pos = pos + 5 * escaped
                    k = np.where(escaped, 0, k)
                k32, rest = k.astype(np.uint32), (31 - k).astype(np.uint32)
            w = peek(pos)
            q = ZEROS[w >> np.uint32(16)]
            if raw is None and int(q.max(initial=0)) < 16 - 7:  # quotient and remainder lie in one window
                low = ((w << (q + 1).astype(np.uint32)) >> np.uint32(1)) >> rest
                if int(k.max()) > 14:
                    low = take(pos + q + 1, k)
                u = (q << k) | low.astype(np.int64)
                pos = pos + q + 1 + k
            else:
                open_ = (q == 16) if raw is None else (q == 16) & ~escaped
                while open_.any():
                    more = ZEROS[peek(pos + q) >> np.uint32(16)]
                    q = np.where(open_, q + more, q)
                    open_ = open_ & (more == 16)
                u = (q << k) | take(pos + q + 1, k)
                if raw is None:
                    pos = pos + q + 1 + k
                else:
                    plain = signed(take(pos, raw), np.maximum(raw, 1))
                    u = np.where(escaped, (plain << 1) ^ (plain >> 63), u)
                    pos = pos + np.where(escaped, raw, q + 1 + k)
            value = ((u >> 1) ^ -(u & 1)).astype(x.dtype)
            if order:
                total = coef[0] * x[t - 1]
                for j in range(1, order):
                    total += coef[j] * x[t - 1 - j]
                value += total >> down
            x[t] = value
        out[(place[lane][:, None] + np.arange(n)).ravel()] = x.T.ravel()
    return out


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream, verified by frame checksums, length and MD5."""
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    out, frames, at, info = [], [], 0, []
    for s in streams:
        own = Stream(s)
        found = find_frames(data, at + own.start, at + len(s))
        if own.samples and (not found or found[0][0] != at + own.start):
            raise ValueError("the first frame is damaged")
        frames += _chain(found, data, at + len(s), 0)
        info.append(own)
        at += len(s)
    by_bits = {own.bits for own in info}
    if len(by_bits) > 1:
        return [decode_many([s])[0] for s in streams]
    samples, at = decode_frames(data, frames, by_bits.pop()) if frames else np.zeros(0, np.int32), 0
    for own in info:
        part = samples[at : at + own.samples]
        if len(part) != own.samples:
            raise ValueError("frames are missing")
        stored = part.astype("<i1" if own.bits <= 8 else "<i2").tobytes()
        if own.md5 != bytes(16) and hashlib.md5(stored).digest() != own.md5:
            raise ValueError("MD5 of the samples fails")
        out.append(part)
        at += own.samples
    if at != len(samples):
        raise ValueError("frames are left over")
    return out


def read_at(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples first to first + count, decoded from the seek point before them."""
    own = Stream(stream)
    data = np.frombuffer(stream + bytes(8), np.uint8)
    if count <= 0 or first >= own.samples:
        return np.zeros(0, np.int32)
    before = [p for p in own.points if p[0] <= first] or [(0, 0, FRAME)]
    after = [p for p in own.points if p[0] >= first + count]
    stop = own.start + after[0][1] if after else len(stream)
    found = find_frames(data, own.start + before[-1][1], stop)
    samples = decode_frames(data, _chain(found, data, stop, found[0][2]), own.bits)
    skip = first - before[-1][0]
    return samples[skip : skip + min(count, own.samples - first)]


def features(samples: np.ndarray) -> str:
    """Integer statistics of a signal: length, range, mean and power in thousandths, sign changes, and mean step."""
    x = samples.astype(np.int64)
    n = max(len(x), 1)
    changes = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"n={len(x)};min={x.min(initial=0)};max={x.max(initial=0)};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n};zc={changes};step={int(np.abs(np.diff(x)).sum()) * 1000 // n}"


def padded(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % FRAME or (0 if data else FRAME))


def _map(df: DataFrame, schema: str, types: list, fn) -> DataFrame:
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_pylist()
            for a, b in slices(sizes, SIDE_BY_SIDE):
                part = batch.slice(a, b - a)
                made = fn(*(c.to_pylist() for c in part.columns[1:]))
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, type=t) for c, t in zip(made, types)], names=names)

    return df.mapInArrow(run, schema)


def encode_column(df: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the column's bytes, padded, as FLAC."""
    kind = df.schema[id_col].dataType.simpleString()

    def encode(data: list) -> tuple[list, list]:
        data = [d or b"" for d in data]
        return [len(d) for d in data], encode_many([padded(d) for d in data])

    return _map(df.select(F.col(id_col), F.col(data_col).cast("binary")), f"`{id_col}` {kind}, n_bytes long, media binary", [pa.int64(), pa.binary()], encode)


def decode_column(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media, pcm, feature): pcm is the payload as it was before encoding (unsigned 8-bit samples)."""
    kind = media.schema[id_col].dataType.simpleString()

    def decode(n_bytes: list, streams: list) -> tuple:
        samples = decode_many(streams)
        return n_bytes, streams, [(s + 128).astype(np.uint8).tobytes() for s in samples], [features(s) for s in samples]

    return _map(media.select(id_col, "n_bytes", "media"), f"`{id_col}` {kind}, n_bytes long, media binary, pcm binary, feature string", [pa.int64(), pa.binary(), pa.binary(), pa.string()], decode)


def pcm_blocks(decoded: DataFrame, samples: int = 64 * FRAME, id_col: str = "doc_id") -> DataFrame:
    """(id, sample_offset, pcm): blocks of samples with the offset of their first one, to be written and sought."""
    offsets = F.explode(F.sequence(F.lit(0), F.greatest(F.length("pcm") - 1, F.lit(0)), F.lit(samples)))
    return decoded.select(id_col, "pcm", offsets.alias("sample_offset")).select(id_col, "sample_offset", F.expr(f"substring(pcm, sample_offset + 1, {samples})").alias("pcm"))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    tail = F.expr("substring(pcm, -16, 16)")
    return decoded.select(
        id_col, "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
