"""Media column: FLAC streams of 8-bit mono samples, and PCM blocks decoded from them.

Frames are worked on side by side: a step of the Rice decoder or of a linear
predictor handles one sample of every frame of a batch, so that the number of
steps is that of a block's samples and not of the batch's.

Defined cases: a null text counts as empty; an empty payload becomes one block of
padding; streams other than mono with 8 or 16 bits and no wasted bits, and frames
whose checksums fail, raise ValueError; equal texts give equal rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, shared_dir

BLOCK = 576
#: Frames from one seek point to the next.
POINT = 64
#: Fixed predictors of the format, as coefficients of the samples before.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
#: Precision and shift of the encoder's own predictor coefficients.
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 2, 8, 6
RATE = 8000
#: Samples of a PCM block that a stream is read by.
PCM = 1 << 16
#: How streams are packed on disk: large pages, so that copies of a text are found in one.
PACKING = {"compression": "zstd", "parquet.compression.codec.zstd.level": "17", "parquet.page.size": str(8 << 20)}
#: Bytes that are encoded or decoded side by side; their arrays take some fifty times as much.
AT_ONCE = 3 << 19


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)
ZEROS = np.array([16, *(16 - int(i).bit_length() for i in range(1, 1 << 16))], np.int64)


def crc_many(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksums of many stretches of one buffer, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    begin, length = start[order], size[order]
    crc = np.zeros(len(start), np.uint16)
    alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    wide = table is CRC16
    for k, n in enumerate(alive.tolist()):
        c, b = crc[:n], data[begin[:n] + k]
        crc[:n] = (c << 8) ^ table[(c >> 8) ^ b] if wide else table[c ^ b]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def number_bytes(i: int) -> bytes:
    """A frame's number, coded as UTF-8 codes code points (to 36 bits)."""
    if i < 128:
        return bytes([i])
    tail = []
    room = 5
    while True:
        tail.append(0x80 | i & 63)
        i >>= 6
        if i < 1 << room:
            return bytes([(0xFF << (room + 1)) & 0xFF | i, *reversed(tail)])
        room -= 1


def put(bits: np.ndarray, at: np.ndarray, value: np.ndarray | int, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def residual(x: np.ndarray, coefficients: list[np.ndarray], shift: int) -> np.ndarray:
    """Prediction errors of samples (rows of frames), zero in the warm-up."""
    order, out = len(coefficients), x.copy()
    if order:
        guess = sum(c * x[:, order - 1 - j : x.shape[1] - 1 - j] for j, c in enumerate(coefficients))
        out[:, order:] -= guess >> shift
        out[:, :order] = 0
    return out


def own_predictor(x: np.ndarray) -> list[np.ndarray]:
    """Quantised order-2 coefficients of each frame by its autocorrelation."""
    y = x.astype(np.float64)
    r0, r1, r2 = ((y[:, k:] * y[:, : y.shape[1] - k]).sum(1) for k in range(3))
    det = np.where((d := r0 * r0 - r1 * r1) > 0, d, 1.0)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    fit = (r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det)
    return [np.clip(np.rint(c * (1 << LPC_SHIFT)), -limit, limit).astype(np.int32)[:, None] for c in fit]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload, whose bytes less 128 are the samples.

    Each frame takes the cheapest of a constant, verbatim samples, a fixed predictor
    of order 0 to 2 and a linear predictor of its own.
    """
    data = np.frombuffer(b"".join(payloads), np.uint8)
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"payloads are positive multiples of {BLOCK} bytes")
    x = data.reshape(-1, BLOCK).astype(np.int32) - 128
    n = len(x)
    lpc = own_predictor(x)
    ways = [(residual(x, [np.int32(c) for c in FIXED[k]], 0), k) for k in range(3)] + [(residual(x, lpc, LPC_SHIFT), -1)]
    cost = np.stack([np.abs(r).sum(1) for r, _ in ways])
    cost[3] += 8 * BLOCK // 100
    pick = cost.argmin(0)
    errors = np.choose(pick[:, None], [r for r, _ in ways])
    order = np.array([0, 1, 2, LPC_ORDER])[pick]
    folded = np.where(errors < 0, -2 * errors - 1, 2 * errors)
    sizes = np.stack([(folded >> k).sum(1) + BLOCK * (k + 1) for k in range(9)]) - order * (np.arange(9) + 1)[:, None]
    rice = sizes.argmin(0)
    extra = np.where(pick == 3, 4 + 5 + LPC_ORDER * LPC_PRECISION, 0)
    body = 8 + 8 * order + extra + 10 + sizes.min(0)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (body >= 8 + 8 * BLOCK)
    coded = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, body))
    number = np.concatenate([np.arange(c) for c in counts])
    heads = [b"\xff\xf8\x20\x02" + number_bytes(i) for i in number.tolist()]
    head = np.fromiter(map(len, heads), np.int64, n) + 1
    size = head + (body + 7) // 8 + 2
    stop = np.cumsum(size)
    start = stop - size
    out = np.zeros(int(stop[-1]) + 8, np.uint8)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    lead = head - 1
    out[np.repeat(start - (np.cumsum(lead) - lead), lead) + np.arange(len(flat))] = flat
    out[start + lead] = crc_many(out, start, lead, CRC8)

    bits = np.zeros(8 * len(out), np.uint8)
    at = 8 * (start + head)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(pick == 3, 31 + LPC_ORDER, 8 + order)))
    put(bits, at + 1, kind, 6)
    at = at + 8
    raw = x & 255
    put(bits, at[constant], raw[constant, 0], 8)
    if verbatim.any():
        put(bits, at[verbatim][:, None] + 8 * np.arange(BLOCK), raw[verbatim], 8)
    for k in range(LPC_ORDER):
        warm = coded & (order > k)
        put(bits, at[warm] + 8 * k, raw[warm, k], 8)
    at = at + 8 * order
    own = coded & (pick == 3)
    put(bits, at[own], LPC_PRECISION - 1, 4)
    put(bits, at[own] + 4, LPC_SHIFT, 5)
    for k, c in enumerate(lpc):
        put(bits, at[own] + 9 + k * LPC_PRECISION, c[own, 0] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    at = at + np.where(own, extra, 0) + 6  # method 0, one partition
    put(bits, at[coded], rice[coded], 4)
    at = at + 4
    for k in np.unique(rice[coded]).tolist():
        for o in np.unique(order[coded & (rice == k)]).tolist():
            rows = np.flatnonzero(coded & (rice == k) & (order == o))
            u = folded[rows, o:]
            q = u >> k
            length = q + (k + 1)
            one = at[rows][:, None] + np.cumsum(length, 1) - (k + 1)
            bits[one] = 1
            for j in range(k):
                bits[one + 1 + j] = (u >> (k - 1 - j)) & 1
    out |= np.packbits(bits)
    crc = crc_many(out, start, size - 2, CRC16)
    out[stop - 2], out[stop - 1] = crc >> 8, crc & 255

    streams, frame, whole = [], 0, out.tobytes()
    for p, c in zip(payloads, counts):
        a, b = int(start[frame]), int(stop[frame + c - 1])
        least, most = int(size[frame : frame + c].min()), int(size[frame : frame + c].max())
        info = BLOCK.to_bytes(2) * 2 + least.to_bytes(3) + most.to_bytes(3)
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8)
        samples = (data[frame * BLOCK : (frame + c) * BLOCK] ^ 128).tobytes()
        info += hashlib.md5(samples, usedforsecurity=False).digest()
        points = [k for k in range(0, c, POINT)][1:]
        table = b"".join((k * BLOCK).to_bytes(8) + (int(start[frame + k]) - a).to_bytes(8) + BLOCK.to_bytes(2) for k in points)
        seek = b"\x83" + len(table).to_bytes(3) + table if points else b""
        streams.append(b"fLaC" + (b"\0" if points else b"\x80") + len(info).to_bytes(3) + info + seek + whole[a:b])
        frame += c
    return streams


@dataclass
class Info:
    """What a stream's header says, where its first frame starts and what number it has, and
    the seek points: ``(sample, place)``."""

    block: int
    bits: int
    total: int
    md5: bytes
    start: int
    number: int = 0
    points: tuple[tuple[int, int], ...] = ()

    @classmethod
    def of(cls, stream: bytes) -> Info:
        if stream[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, found, points = 4, None, []
        while True:
            kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
            if kind & 127 == 0:
                s = stream[at + 4 : at + 4 + size]
                packed = int.from_bytes(s[10:18])
                if (packed >> 41) & 7 or (packed >> 36 & 31) not in (7, 15):
                    raise ValueError("only mono streams of 8 or 16 bits")
                found = (int.from_bytes(s[2:4]), (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, s[18:34])
            elif kind & 127 == 3:
                for p in range(at + 4, at + 4 + size - 17, 18):
                    points.append((int.from_bytes(stream[p : p + 8]), int.from_bytes(stream[p + 8 : p + 16])))
            at += 4 + size
            if kind & 128:
                break
        if not found:
            raise ValueError("no STREAMINFO")
        unused = (1 << 64) - 1  # marks a place that holds no point
        return cls(*found, at, points=tuple((k, at + o) for k, o in points if k != unused))


#: Block sizes by the header's code, where the code alone gives it.
SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


def frame_heads(data: bytes, at: int, number: int) -> tuple[int, int] | None:
    """``(header's size, samples)`` of the frame with that number at a place, if its CRC-8 holds."""
    coded = number_bytes(number)
    if data[at : at + 2] != b"\xff\xf8" or data[at + 4 : at + 4 + len(coded)] != coded:
        return None
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    end = at + 4 + len(coded)
    if code in (6, 7):
        samples = int.from_bytes(data[end : end + code - 5]) + 1
        end += code - 5
    elif code in SIZES:
        samples = SIZES[code]
    else:
        return None
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for b in data[at:end]:
        crc = int(CRC8[crc ^ b])
    return (end + 1 - at, samples) if end < len(data) and data[end] == crc else None


def find_frames(stream: bytes, info: Info) -> list[tuple[int, int, int]]:
    """``(place, header's size, samples)`` of every frame.

    A sync code with a good header may lie inside a frame; then the CRC-16 up to it
    fails, and the frame goes on to the next such place.
    """
    frames, at, done = [], info.start, 0
    while done < info.total:
        head = frame_heads(stream, at, info.number + len(frames))
        if head is None:
            raise ValueError(f"no frame {info.number + len(frames)}")
        frames.append((at, *head))
        done += head[1]
        if done >= info.total:
            break
        after = at + head[0]
        while True:
            after = stream.find(b"\xff\xf8", after)
            if after < 0:
                raise ValueError(f"frame {info.number + len(frames)} is missing")
            if frame_heads(stream, after, info.number + len(frames)):
                break
            after += 1
        at = after
    return frames


def checked_frames(stream: bytes, info: Info) -> list[tuple[int, int, int]]:
    """The slow way for a stream with a false sync code: every end is tried against the CRC-16."""
    frames, at, done = [], info.start, 0
    while done < info.total:
        head = frame_heads(stream, at, info.number + len(frames))
        if head is None:
            raise ValueError(f"no frame {info.number + len(frames)}")
        frames.append((at, *head))
        done += head[1]
        crc, last, end = 0, done >= info.total, at
        while True:
            stop = len(stream) if last else stream.find(b"\xff\xf8", max(end, at + head[0]) + 1)
            if stop < 0:
                raise ValueError(f"checksum of frame {len(frames) - 1}")
            for b in stream[end:stop]:
                crc = (crc << 8 & 0xFFFF) ^ int(CRC16[(crc >> 8) ^ b])
            end = stop
            if crc == 0 and (last or frame_heads(stream, stop, info.number + len(frames))):
                break
            if last:
                raise ValueError(f"checksum of frame {len(frames) - 1}")
        at = end
    return frames


class Reader:
    """Reads bits at many places of one buffer at once."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint32)
        n = len(data) + 8
        self.words = (padded[:n] << 24) | (padded[1 : n + 1] << 16) | (padded[2 : n + 2] << 8) | padded[3 : n + 3]

    def window(self, at: np.ndarray) -> np.ndarray:
        """32 bits from each place on, of which 25 are good."""
        return self.words[at >> 3] << (at & 7).astype(np.uint32)

    def unsigned(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 25 bits."""
        return (self.window(at).astype(np.int64) >> (32 - width)) & ((1 << np.asarray(width, np.int64)) - 1)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = self.unsigned(at, width)
        half = np.where(np.asarray(width) > 0, 1 << np.maximum(np.asarray(width, np.int64) - 1, 0), 1)
        return np.where(v >= half, v - 2 * half, v) * (np.asarray(width) > 0)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Folded values with parameters k, and the places after them."""
        w = self.window(at)
        q = ZEROS[w >> 16]
        long = q == 16
        if long.any():
            p, more = at[long] + 16, np.full(int(long.sum()), 16)
            open_ = np.ones(len(p), bool)
            while open_.any():
                z = ZEROS[self.window(p[open_]) >> 16]
                more[open_] += z
                p[open_] += z
                open_[open_] = z == 16
            q = q.copy()
            q[long] = more
        low = ((w.astype(np.int64) << (q + 1).clip(max=31)) & 0xFFFFFFFF) >> (32 - k)
        far = q + 1 + k > 25
        if far.any():
            low[far] = self.unsigned(at[far] + q[far] + 1, k[far])
        return q << k | low, at + q + 1 + k


def residuals(read: Reader, at: np.ndarray, block: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Decoded residuals (samples by frames) of frames with one block size, method and partition order."""
    out = np.zeros((block, len(at)), np.int32)
    setting = read.unsigned(at, 6)
    for s in np.unique(setting):
        rows = np.flatnonzero(setting == s)
        method, parts = int(s) >> 4, 1 << (int(s) & 15)
        if method > 1:
            raise ValueError("unknown residual method")
        width, p = (4, 5)[method], at[rows] + 6
        sample = order
        for part in range(parts):
            k = read.unsigned(p, width)
            p = p + width
            escape = k == (1 << width) - 1
            some = escape.any()
            if some:
                size = np.where(escape, read.unsigned(p, 5), 0)
                p = p + 5 * escape
                k = np.where(escape, 0, k)
            for sample in range(sample, block * (part + 1) // parts):
                if some:
                    plain = read.signed(p, size)
                    u, after = read.rice(p, k)
                    v = np.where(escape, plain, (u >> 1) ^ -(u & 1))
                    p = np.where(escape, p + size, after)
                else:
                    u, p = read.rice(p, k)
                    v = (u >> 1) ^ -(u & 1)
                out[sample, rows] = v
            sample = block * (part + 1) // parts
        at[rows] = p
    return out, at


def decode(streams: list[bytes], infos: list[Info] | None = None) -> list[np.ndarray]:
    """The samples of every stream (or of the part that ``infos`` names, up to the stream's end);
    every frame's checksums and, of whole streams, the MD5 are verified."""
    infos = infos or [Info.of(s) for s in streams]
    found = [find_frames(s, i) for s, i in zip(streams, infos)]
    data = np.frombuffer(b"".join(streams), np.uint8)
    shift = np.concatenate([[0], np.cumsum([len(s) for s in streams])])

    def laid_out():
        of = np.repeat(np.arange(len(streams)), [len(f) for f in found])
        place = np.array([x[0] for f in found for x in f], np.int64) + shift[of]
        last = np.concatenate([of[1:] != of[:-1], [True]]) if len(of) else np.zeros(0, bool)
        stop = np.where(last, shift[of + 1], np.roll(place, -1))
        return of, place, stop

    of, place, stop = laid_out()
    bad = np.unique(of[crc_many(data, place, stop - place, CRC16) != 0]).tolist()
    if bad:  # the checksum of a frame with its own checksum is 0
        for i in bad:
            found[i] = checked_frames(streams[i], infos[i])
        of, place, stop = laid_out()
    head = np.array([x[1] for f in found for x in f], np.int64)
    block = np.array([x[2] for f in found for x in f], np.int64)
    depth = np.array([i.bits for i in infos], np.int64)[of]
    read = Reader(data)
    at = 8 * (place + head)
    kind = read.unsigned(at, 8)
    if (kind & 129).any():
        raise ValueError("wasted bits are not read")
    kind >>= 1
    at = at + 8
    offset = np.cumsum(block) - block
    samples = np.zeros(int(block.sum()), np.int32)
    keys = (kind << 24) | (block << 6) | depth
    for key in np.unique(keys).tolist():
        rows = np.flatnonzero(keys == key)
        what, n, bits = key >> 24, key >> 6 & 0x3FFFF, key & 63
        p = at[rows].copy()
        if what == 0:
            x = np.repeat(read.signed(p, bits)[None], n, 0)
        elif what == 1:
            x = read.signed(p + bits * np.arange(n)[:, None], bits)
        elif 8 <= what <= 12 or what >= 32:
            order = what - 8 if what < 32 else what - 31
            warm = [read.signed(p + bits * j, bits) for j in range(order)]
            p += bits * order
            if what < 32:
                taps, down = [np.full(len(rows), c) for c in FIXED[order]], np.zeros(len(rows), np.int64)
            else:
                precision, down = read.unsigned(p, 4) + 1, read.unsigned(p + 4, 5)
                taps = [read.signed(p + 9 + j * precision, precision) for j in range(order)]
                p += 9 + order * precision
            x, _ = residuals(read, p, n, order)
            if order:
                x = x.astype(np.int64)
                for j in range(order):
                    x[j] = warm[j]
                for t in range(order, n):
                    guess = taps[0] * x[t - 1]
                    for j in range(1, order):
                        guess += taps[j] * x[t - 1 - j]
                    x[t] += guess >> down
        else:
            raise ValueError("reserved subframe type")
        samples[offset[rows][None] + np.arange(n)[:, None]] = x
    ends = np.cumsum([i.total for i in infos])
    out = [samples[e - i.total : e] for e, i in zip(ends.tolist(), infos)]
    for x, i in zip(out, infos):
        if i.md5 != bytes(16) and hashlib.md5(x.astype("<i1" if i.bits == 8 else "<i2").tobytes(), usedforsecurity=False).digest() != i.md5:
            raise ValueError("MD5 of the samples")
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's size in UTF-8, and its bytes padded by 255 to a positive multiple of a block."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\xff")


def to_flac(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media``: every whole text as a FLAC stream."""

    def run(ids: list, texts: list) -> dict[str, list]:
        payloads = [payload_of(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [n for n, _ in payloads], "media": encode([p for _, p in payloads])}

    return map_rows(docs, [id_col, text_col], run, "doc_id bigint, n_bytes bigint, media binary", AT_ONCE)


def read_samples(stream: bytes, first: int, n: int) -> np.ndarray:
    """``n`` samples from ``first`` on (fewer at the end), decoding only the frames that hold them:
    from the last seek point before, headers are followed to the frames."""
    info = Info.of(stream)
    end = min(first + n, info.total)
    if end <= first:
        return np.zeros(0, np.int32)
    sample, at = max([(0, info.start), *(p for p in info.points if p[0] <= first)])
    rest = replace(info, start=at, number=sample // info.block, total=min(info.total - sample, end - sample + info.block))
    frames = find_frames(stream, rest)
    ends = sample + np.cumsum([f[2] for f in frames])
    skip, last = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, end, "left"))
    stop = frames[last + 1][0] if last + 1 < len(frames) else len(stream)
    before = int(ends[skip - 1]) if skip else sample
    own = replace(info, start=frames[skip][0], number=rest.number + skip, total=int(ends[last]) - before, md5=bytes(16))
    return decode([stream[:stop]], [own])[0][first - before : end - before]


def blocks_of(stream: bytes, samples: np.ndarray, block: int) -> Iterator[tuple[int, int, int, bytes]]:
    """PCM blocks of a decoded stream: number, first sample, samples, and their bytes."""
    kind = "<i1" if Info.of(stream).bits == 8 else "<i2"
    for k, a in enumerate(range(0, len(samples), block)):
        part = samples[a : a + block]
        yield k, a, len(part), part.astype(kind).tobytes()


def pcm_blocks(media: DataFrame, *, block: int = 4096, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """PCM blocks of every stream: ``doc_id``, ``block``, ``first_sample`` (where to seek), ``n_samples``, ``pcm``.

    A null stream has no blocks."""

    def run(ids: list, streams: list) -> dict[str, list]:
        kept = [(i, s) for i, s in zip(ids, streams) if s is not None]
        out: dict[str, list] = {"doc_id": [], "block": [], "first_sample": [], "n_samples": [], "pcm": []}
        for (i, s), x in zip(kept, decode([s for _, s in kept]) if kept else []):
            for row in blocks_of(s, x, block):
                for c, v in zip(out, (i, *row)):
                    out[c].append(v)
        return out

    schema = "doc_id bigint, block bigint, first_sample bigint, n_samples bigint, pcm binary"
    return map_rows(media, [id_col, media_col], run, schema, AT_ONCE)


def write_pcm_blocks(media: DataFrame, target: str, *, block: int = 4096) -> None:
    """The PCM blocks of all streams as a table, a stream's blocks side by side in order of samples."""
    pcm_blocks(media, block=block).write.parquet(target)


def folded(blocks: Iterator[tuple[int, int, int, bytes]]) -> tuple[int, str, int, str]:
    """Size, SHA-256, CRC-32 of the last 32 bytes and feature of the payload in a stream's PCM blocks, block by block."""
    digest, tail, size, total, squares, changes, last = hashlib.sha256(), b"", 0, 0, 0, 0, None
    for _, first, _, pcm in blocks:
        if first != size:
            raise ValueError("a block is missing")
        x = np.frombuffer(pcm, "<i1").astype(np.int64)
        payload = (x + 128).astype(np.uint8).tobytes()
        digest.update(payload)
        tail, size = (tail + payload)[-32:], size + len(payload)
        sign = x < 0
        changes += int((sign[1:] != sign[:-1]).sum()) + (last is not None and last != bool(sign[0]))
        total, squares, last = total + int(x.sum()), squares + int((x * x).sum()), bool(sign[-1])
    return size, digest.hexdigest(), zlib.crc32(tail), f"blocks={size // BLOCK};sum={total};squares={squares};sign_changes={changes}"


def stored_features(docs: DataFrame) -> DataFrame:
    """The columns of :func:`media_features` by way of the shared folder: the streams are written
    and read back, and the payload's digests come from the PCM blocks decoded from them.

    The blocks themselves are passed on in memory: with them on disk as well (:func:`write_pcm_blocks`)
    a corpus takes more than twice its size."""
    target = shared_dir(docs.sparkSession, "media")
    media = to_flac(docs)
    media.write.options(**PACKING).parquet(target)
    return media_features(docs.sparkSession.read.schema(media.schema).parquet(target))


def media_features(media: DataFrame) -> DataFrame:
    """Read the streams of :func:`to_flac` back: digests, and as feature the number of
    blocks, sum, sum of squares and sign changes of the samples."""

    def run(ids: list, sizes: list, streams: list) -> dict[str, list]:
        found = [folded(blocks_of(s, x, PCM)) for s, x in zip(streams, decode(streams))]
        return {
            "doc_id": ids,
            "n_bytes": sizes,
            "payload_bytes": [f[0] for f in found],
            "payload_sha256": [f[1] for f in found],
            "tail_crc32": [f[2] for f in found],
            "media_bytes": [len(s) for s in streams],
            "media_sha256": [hashlib.sha256(s).hexdigest() for s in streams],
            "feature": [f[3] for f in found],
        }

    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )
    return map_rows(media, ["doc_id", "n_bytes", "media"], run, schema, AT_ONCE)
