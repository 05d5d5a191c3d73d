"""FLAC media columns: encode, decode and address mono PCM.

Frames of many streams are handled side by side in numpy: one step takes the next code of
every frame. Streams are self-contained: stream information with the MD5 of the samples, a
seek table with a point for every frame, and frames with header and body checksums.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pick, table

#: Samples of a frame, samples of which one step makes or reads frames, and the declared rate.
BLOCK, STEP_BYTES, RATE, ALIGN = 1024, 1 << 18, 8000, 64
#: Longest run of zeros before a stop bit, linear predictor precision and shift.
MOST_ZEROS, PRECISION, SHIFT = 40, 8, 6


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        c = byte << bits - 8
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


@lru_cache(maxsize=10_000)
def crc8(data: bytes) -> int:
    c = 0
    for byte in data:
        c = int(CRC8[c ^ byte])
    return c


def crc16(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of many byte ranges at once."""
    order = np.argsort(-lengths, kind="stable")
    s, crc = starts[order], np.zeros(len(starts), np.uint16)
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    for i, n in enumerate(active.tolist()):
        c = crc[:n]
        crc[:n] = (c << 8) ^ CRC16[(c >> 8) ^ buffer[s[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(maxsize=10_000)
def frame_header(number: int, size: int) -> bytes:
    if number < 0x80:
        coded = bytes([number])
    else:
        more = next(n for n in range(1, 7) if number < 1 << (5 * n + 6))
        coded = bytes([(0xFF00 >> more + 1 & 0xFF) | number >> 6 * more, *(0x80 | number >> 6 * i & 0x3F for i in range(more - 1, -1, -1))])
    head = b"\xff\xf8" + bytes([0x74, 0x02]) + coded + struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Streams of payloads of any length, as ``encode_many`` gives them, in steps of ``STEP_BYTES`` at most."""
    short = [p for p in payloads if len(p) <= STEP_BYTES]
    made = dict(zip(short, encode_many(short))) if short else {}
    return [made[p] if len(p) <= STEP_BYTES else encode_long(p) for p in payloads]


def encode_long(payload: bytes) -> bytes:
    """The stream of one payload, a step of whole frames after the other."""
    frames, points, sizes, md5, at = [], [], [], hashlib.md5(), 0
    for start in range(0, len(payload), STEP_BYTES):
        part = payload[start : start + STEP_BYTES]
        media = encode_many([part], start // BLOCK)[0]
        _, held, begin = read_metadata(media)
        held[:, 0] += start
        held[:, 1] += at
        points.append(held)
        sizes += [int.from_bytes(media[12:15], "big"), int.from_bytes(media[15:18], "big")]
        frames.append(media[begin:])
        at += len(frames[-1])
        md5.update((np.frombuffer(part, np.uint8) ^ 128).tobytes())
    return _stream(len(payload), min(sizes[::2]), max(sizes[1::2]), md5.digest(), np.concatenate(points)) + b"".join(frames)


def _stream(samples: int, least: int, most: int, digest: bytes, points: np.ndarray) -> bytes:
    """What precedes the frames: stream information and the seek table (sample, offset, count)."""
    table = np.zeros(len(points), [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
    for i, name in enumerate(("sample", "offset", "count")):
        table[name] = points[:, i]
    info = struct.pack(">HH", min(BLOCK, max(16, samples)), min(BLOCK, max(16, samples))) + least.to_bytes(3, "big") + most.to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + digest
    return b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + table.tobytes()


def encode_many(payloads: list[bytes], number: int = 0) -> list[bytes]:
    """Lossless 8-bit mono streams; sample = byte - 128. Every payload has a byte at least.

    Frames are counted from ``number``.

    Of each frame's predictors (fixed of order 0 to 2, linear of order 2) the one with the
    smallest residuals is kept, and coded with one Rice parameter.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    frames = -(-sizes // BLOCK)
    nth = np.arange(int(frames.sum())) - np.repeat(np.cumsum(frames) - frames, frames)
    start = np.repeat(np.cumsum(sizes) - sizes, frames) + nth * BLOCK
    length = np.minimum(BLOCK, np.repeat(sizes, frames) - nth * BLOCK)
    place = np.arange(len(x)) - np.repeat(start, length)
    x1, x2 = np.r_[0, x[:-1]], np.r_[0, 0, x[:-2]][: len(x)]
    x1[place < 1] = 0
    x2[place < 2] = 0

    # Linear predictor of order 2 by least squares over the frame.
    a, b, c = _sums(x1 * x1, start).astype(float), _sums(x1 * x2, start).astype(float), _sums(x2 * x2, start).astype(float)
    p, q = _sums(x * x1, start).astype(float), _sums(x * x2, start).astype(float)
    det = a * c - b * b
    det[np.abs(det) < 1] = np.inf
    limit = 1 << PRECISION - 1
    linear = [np.clip(np.round(v / det * (1 << SHIFT)), -limit, limit - 1).astype(np.int32) for v in (c * p - b * q, a * q - b * p)]
    long = [np.repeat(v, length) for v in linear]
    residuals = [x, x - x1, x - 2 * x1 + x2, x - ((long[0] * x1 + long[1] * x2) >> SHIFT)]
    orders = np.array([0, 1, 2, 2])
    cost = np.stack([_sums(np.where(place >= o, np.abs(r), 0), start) for r, o in zip(residuals, orders)])
    cost[1:, length < 3] = 1 << 60
    method = cost.argmin(axis=0)
    order = orders[method]
    chosen = np.choose(np.repeat(method, length), residuals)
    folded = ((chosen << 1) ^ (chosen >> 31)).astype(np.uint64)

    warm = place < np.repeat(order, length)
    coded = np.where(warm, 0, folded)
    mean = _sums(coded, start) / np.maximum(1, length - order)
    most = np.maximum.reduceat(coded, start).astype(float)
    k = np.floor(np.log2(np.maximum(1, np.maximum(mean, most / MOST_ZEROS * 2)))).astype(np.int64)

    # Codes of a frame: type byte, warm-up samples, parameters, residuals.
    slots = length + 2
    slot0 = np.cumsum(slots) - slots
    values, bits = np.empty(int(slots.sum()), np.uint64), np.empty(int(slots.sum()), np.int64)
    values[slot0], bits[slot0] = np.where(method == 3, 0x20 | 1, 0x08 | order) << 1, 8
    own = np.repeat(slot0 + 1, length) + place + ~warm
    wide = np.repeat(k, length).astype(np.uint64)
    values[own] = np.where(warm, (x & 255).astype(np.uint64), (np.uint64(1) << wide) | (folded & ((np.uint64(1) << wide) - np.uint64(1))))
    bits[own] = np.where(warm, 8, (folded >> wide).astype(np.int64) + 1 + wide.astype(np.int64))
    mask = (1 << PRECISION) - 1
    rule = ((PRECISION - 1) << 5 | SHIFT) << 2 * PRECISION | (linear[0].astype(np.int64) & mask) << PRECISION | linear[1].astype(np.int64) & mask
    at = slot0 + 1 + order
    values[at] = np.where(method == 3, rule << 10 | k, k)
    bits[at] = np.where(method == 3, 9 + 2 * PRECISION + 10, 10)

    total = np.cumsum(bits)
    body = -(-np.add.reduceat(bits, slot0) // 8)
    heads = [frame_header(number + n, s) for n, s in zip(nth.tolist(), length.tolist())]
    head_size = np.array([len(h) for h in heads])
    frame_size = head_size + body + 2
    first = np.cumsum(frames) - frames
    meta = 42 + 4 + 18 * frames
    within = np.cumsum(frame_size) - frame_size
    stream_size = meta + np.add.reduceat(frame_size, first)
    stream_at = np.cumsum(stream_size) - stream_size
    offset = within - np.repeat(within[first], frames)  # from the first frame of its stream
    frame_at = np.repeat(stream_at + meta, frames) + offset

    position = np.repeat((frame_at + head_size) * 8 - (total[slot0] - bits[slot0]), slots) + total - bits
    word, room = position >> 6, 64 - (position & 63)
    over = np.maximum(0, bits - room)
    high = (values >> over.astype(np.uint64)) << np.maximum(0, room - bits).astype(np.uint64)
    out = np.zeros(int(stream_size.sum()) // 8 + 2, np.uint64)
    runs = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[runs]] = np.bitwise_or.reduceat(high, runs)
    spill = np.flatnonzero(over)
    out[word[spill] + 1] |= values[spill] << (64 - over[spill]).astype(np.uint64)
    buffer = out.byteswap().view(np.uint8)
    raw = memoryview(buffer)
    for o, h in zip(frame_at.tolist(), heads):
        raw[o : o + len(h)] = h
    check = crc16(buffer, frame_at, frame_size - 2)
    end = frame_at + frame_size
    buffer[end - 2], buffer[end - 1] = check >> 8, check & 255

    signed = (x & 255).astype(np.uint8)
    points = np.stack([nth * BLOCK, offset, length], axis=1)
    result = []
    for i, (f, n, s, o) in enumerate(zip(first.tolist(), frames.tolist(), sizes.tolist(), stream_at.tolist())):
        held, sample0 = frame_size[f : f + n], int(start[f])
        head = _stream(s, int(held.min()), int(held.max()), hashlib.md5(signed[sample0 : sample0 + s]).digest(), points[f : f + n])
        raw[o : o + len(head)] = head
        result.append(bytes(raw[o : o + int(stream_size[i])]))
    return result


class Damaged(ValueError):
    """A stream that breaks the format or a checksum."""


def read_metadata(media: bytes) -> tuple[dict, np.ndarray, int]:
    """Stream information, seek points (sample, offset, count) and where the frames begin."""
    if media[:4] != b"fLaC":
        raise Damaged("no stream marker")
    at, last, info, points = 4, False, None, np.zeros((0, 3), np.int64)
    while not last:
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        part = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(part[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": part[18:34]}
        elif kind == 3:
            held = np.frombuffer(part, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
            held = held[held["sample"] != 0xFFFFFFFFFFFFFFFF]
            points = np.stack([held[c].astype(np.int64) for c in ("sample", "offset", "count")], axis=1)
        at += 4 + size
    if info is None or info["channels"] != 1:
        raise Damaged("only mono streams with stream information are read")
    return info, points, at


def read_header(media: bytes, at: int) -> tuple[int, int]:
    """Size of the header at ``at`` and samples of its frame; its checksum is verified."""
    if media[at] != 0xFF or media[at + 1] & 0xFE != 0xF8:
        raise Damaged("no frame where one should begin")
    code, rate = media[at + 2] >> 4, media[at + 2] & 15
    end, lead = at + 5, media[at + 4]
    while lead & 0xC0 == 0xC0:  # one more byte for each further leading one
        lead = lead << 1 & 0xFF
        end += 1
    if code in (6, 7):
        size = int.from_bytes(media[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        size = 192 if code == 1 else 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(media[at:end]) != media[end]:
        raise Damaged("a frame header's checksum is wrong")
    return end + 1 - at, size


def read_subframe(data: bytes, at: int, size: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples of any subframe that begins at byte ``at``, bit by bit, and the bits it took."""
    bits, cursor = int.from_bytes(data[at:], "big"), (len(data) - at) * 8

    def take(n: int) -> int:
        nonlocal cursor
        cursor -= n
        return bits >> cursor & (1 << n) - 1

    def signed(n: int) -> int:
        v = take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary() -> int:
        n = cursor - (bits & (1 << cursor) - 1).bit_length()
        take(n + 1)
        return n

    kind = take(7)
    wasted = unary() + 1 if take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [signed(depth)] * size
    elif kind == 1:
        out = [signed(depth) for _ in range(size)]
    else:
        order = kind - 8 if kind < 32 else kind - 31
        if not (8 <= kind <= 12 or kind >= 32):
            raise Damaged("reserved subframe type")
        out = [signed(depth) for _ in range(order)]
        if kind >= 32:
            precision, shift = take(4) + 1, signed(5)
            rule = [signed(precision) for _ in range(order)]
        else:
            rule, shift = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order], 0
        wide, parts = 4 + take(2), take(4)
        for part in range(1 << parts):
            k = take(wide)
            for _ in range((size >> parts) - (0 if part else order)):
                if k == (1 << wide) - 1:
                    k = -1 - take(5)
                r = signed(-1 - k) if k < 0 else (lambda u: u >> 1 ^ -(u & 1))(unary() << k | take(k))
                out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(rule)) >> shift))
    return np.array(out, np.int64) << wasted, (len(data) - at) * 8 - cursor


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of every stream; frame checksums and the MD5 of the samples are verified."""
    heads = [read_metadata(m) for m in streams]
    frames, slow = [], {}
    for s, (media, (info, points, at)) in enumerate(zip(streams, heads)):
        if len(points) and points[0, 0] == 0 and int(points[:, 2].sum()) == info["samples"]:
            ends = np.r_[points[1:, 1], len(media) - at] + at
            for (_, offset, _), end in zip(points.tolist(), ends.tolist()):
                head, size = read_header(media, at + offset)
                frames.append((s, at + offset, head, size, end - at - offset))
        else:  # no seek point for every frame: one frame tells where the next begins
            out = []
            while at < len(media):
                head, size = read_header(media, at)
                samples, took = read_subframe(media, at + head, size, info["bits"])
                end = at + head + -(-took // 8) + 2
                frame = np.frombuffer(media[at:end], np.uint8)
                if crc16(frame, np.array([0]), np.array([len(frame)]))[0]:
                    raise Damaged("a frame's checksum is wrong")
                out.append(samples)
                at = end
            slow[s] = np.concatenate(out) if out else np.zeros(0, np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    # A step reads frames of about so many bytes, however long their streams are.
    step = np.cumsum([total for *_, total in frames]) // (4 * STEP_BYTES)
    for group in np.split(np.arange(len(frames)), np.flatnonzero(np.diff(step)) + 1) if frames else ():
        held = [frames[i] for i in group]
        buffer = np.frombuffer(b"".join(streams[s][at : at + total] for s, at, _, _, total in held) + bytes(16), np.uint8)
        which, _, head, size, total = (np.array(c) for c in zip(*held))
        at = np.cumsum(total) - total
        if crc16(buffer, at, total).any():  # over the checksum too, it comes out as zero
            raise Damaged("a frame's checksum is wrong")
        depth = np.array([heads[s][0]["bits"] for s in which.tolist()])
        for s, samples in zip(which.tolist(), _read_frames(buffer, at + head, size, depth, at + total)):
            parts[s].append(samples.astype(np.int16 if heads[s][0]["bits"] <= 8 else np.int64))
    result = []
    for s, (info, *_) in enumerate(heads):
        samples = slow[s] if s in slow else np.concatenate(parts[s])
        raw = samples.astype(f"<i{-(-info['bits'] // 8)}").tobytes() if info["bits"] != 24 else None
        if len(samples) != info["samples"] or raw is not None and any(info["md5"]) and hashlib.md5(raw).digest() != info["md5"]:
            raise Damaged("the samples differ from those stored")
        result.append(samples)
    return result


def _field(buffer: np.ndarray, position: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Unsigned fields of up to 24 bits at bit positions."""
    byte = position >> 3
    window = np.zeros(position.shape, np.int64)
    for i in range(4):
        window = window << 8 | buffer[byte + i]
    return window >> 32 - (position & 7) - bits & (1 << bits) - 1


def _signed(values: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    return values - ((values >> bits - 1 & 1) << bits)


def _read_frames(buffer: np.ndarray, at: np.ndarray, size: np.ndarray, depth: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Samples of frames whose subframes begin at the bytes ``at``, all frames in step."""
    kind = buffer[at].astype(np.int64) >> 1
    linear = kind >= 32
    order = np.where(linear, kind - 31, kind - 8)
    plain = (buffer[at] & 1 == 0) & (linear & (order <= 8) | (kind >= 8) & (kind <= 12)) & (depth <= 16)
    cursor = (at + 1) * 8
    warm = np.zeros((8, len(at)), np.int64)
    rule, shift = np.zeros((8, len(at)), np.int64), np.zeros(len(at), np.int64)
    for o, weights in enumerate(((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))):
        for i, w in enumerate(weights):
            rule[i, ~linear & (order == o)] = w
    for i in range(8):
        use = plain & (order > i)
        warm[i, use] = _signed(_field(buffer, cursor[use], depth[use]), depth[use])
        cursor = cursor + np.where(use, depth, 0)
    use = plain & linear
    precision = np.zeros(len(at), np.int64)
    precision[use] = _field(buffer, cursor[use], 4) + 1
    shift[use] = _signed(_field(buffer, cursor[use] + 4, 5), 5)
    cursor = cursor + np.where(use, 9, 0)
    for i in range(8):
        use = plain & linear & (order > i)
        rule[i, use] = _signed(_field(buffer, cursor[use], precision[use]), precision[use])
        cursor = cursor + np.where(use, precision, 0)
    k = np.zeros(len(at), np.int64)
    k[plain] = _field(buffer, cursor[plain] + 6, 4)
    plain &= (k < 15) & (shift >= 0)
    plain[plain] &= _field(buffer, cursor[plain], 6) == 0  # coded by 4-bit parameters, one partition
    cursor += 10

    out: list[np.ndarray | None] = [None] * len(at)
    for i in np.flatnonzero(~plain):
        out[i] = read_subframe(buffer[at[i] : end[i]].tobytes(), 0, int(size[i]), int(depth[i]))[0]
    use = np.flatnonzero(plain)
    use = use[np.argsort(-(size - order)[use], kind="stable")]
    if len(use):
        count = (size - order)[use]
        ones = np.unpackbits(buffer)
        stops = np.where(ones, np.arange(len(ones), dtype=np.int32), np.int32(2**31 - 1))
        stops = np.minimum.accumulate(stops[::-1])[::-1]
        del ones
        here, step = cursor[use].astype(np.int32), (k[use] + 1).astype(np.int32)
        stop, begun = np.zeros((int(count[0]), len(use)), np.int32), np.zeros((int(count[0]), len(use)), np.int32)
        for i, n in enumerate(np.searchsorted(-count, -np.arange(int(count[0])), side="left").tolist()):
            begun[i, :n] = here[:n]
            stop[i, :n] = stops[here[:n]]
            here[:n] = stop[i, :n] + step[:n]
        del stops
        width = k[use].astype(np.int32)
        tail = stop + 1
        window = np.zeros(len(buffer) - 3, np.uint32)
        for i in range(4):
            window = window << np.uint32(8) | buffer[i : len(buffer) - 3 + i]
        low = (window[tail >> 3] >> (32 - (tail & 7) - width).astype(np.uint32)).astype(np.int32) & (1 << width) - 1
        folded = stop - begun << width | low
        residual = folded >> 1 ^ -(folded & 1)
        del tail, low, folded, stop, begun
        _predict(residual, order[use], linear[use], warm[:, use], rule[:, use], shift[use], count, out, use)
    return out


def _predict(residual, order, linear, warm, rule, shift, count, out, use) -> None:
    """Add what the predictors say to the residuals: running sums, or a recursion in step."""
    for fixed in range(5):
        chosen = np.flatnonzero(~linear & (order == fixed))
        if len(chosen):
            x = residual[:, chosen].astype(np.int64)
            for level in range(fixed - 1, -1, -1):
                x = np.vstack([np.diff(warm[:fixed, chosen], level, axis=0)[-1], x]).cumsum(axis=0)[1:]
            for j, c in enumerate(chosen):
                out[use[c]] = np.r_[warm[:fixed, c], x[: count[c], j]]
    for o in np.unique(order[linear]):
        chosen = np.flatnonzero(linear & (order == o))
        x = np.vstack([warm[:o, chosen], residual[:, chosen]])
        weights, by = rule[:o, chosen], shift[chosen]
        for i in range(o, len(x)):
            said = weights[0] * x[i - 1]
            for j in range(1, o):
                said += weights[j] * x[i - 1 - j]
            x[i] += said >> by
        for j, c in enumerate(chosen):
            out[use[c]] = x[: o + count[c], j]


def _each(column: pa.Array, run) -> list:
    """Apply ``run`` to lists of values that hold about a step's bytes, each distinct value once."""
    out = []
    for batch in chunks(iter([pa.RecordBatch.from_arrays([column], ["v"])]), "v", STEP_BYTES):
        values = batch.column("v").to_pylist()
        known = list(dict.fromkeys(v for v in values if v is not None))
        made = dict(zip(known, run(known))) if known else {}
        out += [made.get(v) for v in values]
    return out


def to_media(text: Column | str) -> Column:
    """FLAC column of a text column: UTF-8 bytes and zeros up to a positive multiple of 64.

    Null is an empty text: 64 zero bytes. Equal texts give equal streams. Texts of any length
    are coded in steps of whole frames.
    """

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        pad = lambda raw: raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN))
        return pa.array(_each(texts.fill_null(""), lambda held: encode([pad(t.encode()) for t in held])), pa.binary())

    # Else the optimizer would encode again for every use of the column.
    return encoded.asNondeterministic()(text)


def feature_of(samples: np.ndarray) -> str:
    """Peak, energy and sign changes of the samples, as integers."""
    peak, energy, crossings, last = 0, 0, 0, None
    for at in range(0, len(samples), STEP_BYTES):
        wide = samples[at : at + STEP_BYTES].astype(np.int64)
        peak, energy = max(peak, int(np.abs(wide).max())), energy + int((wide * wide).sum())
        below = wide < 0
        crossings += int((below[1:] != below[:-1]).sum()) + (last is not None and bool(below[0]) != last)
        last = bool(below[-1])
    return f"peak={peak};energy={energy};crossings={crossings}"


def from_media(media: Column | str) -> Column:
    """struct<pcm, feature> of 8-bit streams, verified; pcm has unsigned bytes. Null stays null."""

    @F.arrow_udf("struct<pcm:binary,feature:string>")
    def decoded(streams: pa.Array) -> pa.Array:
        def run(held: list[bytes]) -> list[dict]:
            return [{"pcm": (s + 128).astype(np.uint8).tobytes(), "feature": feature_of(s)} for s in decode_many(held)]

        return pa.array(_each(streams, run), pa.struct([("pcm", pa.binary()), ("feature", pa.string())]))

    return decoded(media)


def pcm_blocks(df: DataFrame, media: str = "media", block: int = 4096) -> DataFrame:
    """A row per block of PCM: the frame's other columns, sample_offset, n_samples, pcm.

    Samples are signed little-endian, as wide as the stream's; offsets count samples from the
    stream's start, so a reader seeks by them. Null streams have no blocks; a damaged stream
    fails the job.
    """

    @F.arrow_udf("array<struct<sample_offset:bigint,n_samples:int,pcm:binary>>")
    def blocks(streams: pa.Array) -> pa.Array:
        def run(held: list[bytes]) -> list[list[dict]]:
            out = []
            for m, s in zip(held, decode_many(held)):
                kind = f"<i{1 if read_metadata(m)[0]['bits'] <= 8 else 2 if read_metadata(m)[0]['bits'] <= 16 else 4}"
                out.append([{"sample_offset": i, "n_samples": len(s[i : i + block]), "pcm": s[i : i + block].astype(kind).tobytes()} for i in range(0, len(s), block)])
            return out

        kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))
        return pa.array(_each(streams, run), kind)

    # By position, so that columns named alike or like this function's own cannot be confused.
    held = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    others = [(f"_{i}", c) for i, c in enumerate(df.columns) if i != df.columns.index(media)]
    rows = held.select(*[o for o, _ in others], F.explode(blocks(f"_{df.columns.index(media)}")).alias("block"))
    return rows.select(*[F.col(o).alias(c) for o, c in others], "block.sample_offset", "block.n_samples", "block.pcm")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    stored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), to_media("text").alias("media"))
    read = stored.select("doc_id", "n_bytes", "media", from_media("media").alias("read"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("read.pcm").cast("long").alias("payload_bytes"),
        F.sha2("read.pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(read.pcm, -{ALIGN}, {ALIGN})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("read.feature").alias("feature"),
    )
