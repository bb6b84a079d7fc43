"""Media columns: FLAC streams in a binary column, decoded to PCM blocks with seekable sample offsets.

The decoder handles every subframe type of the format (constant, verbatim, fixed and linear predictors), both Rice codings
with partitions and escapes, stereo decorrelation, header CRC-8 and frame CRC-16. Frames of many files are decoded side by
side: one NumPy operation per sample position serves all frames of a chunk. A seek table with a point for each frame (which
the encoder writes) makes all frames of a file start at once; without one, each file's frames follow in waves.

Work is per row, without a shuffle; memory follows the chunk bound, not the number of rows.

Cases. A null stream gives no block rows, a null or empty text the stream of 64 zero bytes. Texts of any length are whole: a longer one
than the chunk bound is a chunk of its own. Repeated rows and ties each give their own result, equal texts equal values. An
empty table gives no rows. A damaged stream gives one row with ok false and leaves the others of its chunk as they are. Of the input only
the named columns are read, so other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_chunks

BLOCK = 4096
#: Fixed values of the format: blocking-strategy codes, and predictor coefficients of the fixed orders 0 to 4.
BLOCK_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
RATE_BYTES = {12: 1, 13: 2, 14: 2}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class BadStream(ValueError):
    """A stream that is no FLAC, is cut short, or fails a checksum."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, v = 1 << (bits - 1), (1 << bits) - 1, np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        v = np.where(v & top, (v << 1) ^ poly, v << 1) & mask
    return v.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_by_distance: list[np.ndarray] = []


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_many(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[starts[i]:ends[i]]. The CRC is linear: each byte adds a value that depends on its distance from the end."""
    longest = int((ends - starts).max(initial=0))
    if not _by_distance:
        _by_distance.append(CRC16.reshape(1, 256))
    table = _by_distance[0]
    while len(table) < longest:  # value at distance d+1: one more zero byte shifted in
        more = np.empty((min(len(table), longest - len(table) + 1), 256), np.uint16)
        last = table[-1]
        for i in range(len(more)):
            last = (last << 8) ^ CRC16[last >> 8]
            more[i] = last
        table = np.concatenate([table, more])
    _by_distance[0] = table
    out = np.zeros(len(starts), np.uint16)
    for lo in range(0, len(starts), 2048):
        s, n = starts[lo : lo + 2048], (ends - starts)[lo : lo + 2048]
        total = np.concatenate([[0], np.cumsum(n)])
        if not total[-1]:
            continue
        owner = np.repeat(np.arange(len(s)), n)
        k = np.arange(total[-1]) - total[owner]
        value = table.reshape(-1)[(n[owner] - 1 - k) * 256 + buf[s[owner] + k]]
        at = np.flatnonzero(n)
        out[lo + at] = np.bitwise_xor.reduceat(value, total[:-1][at])
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like coding."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (5 * more + 6):
        more += 1
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in reversed(range(more))]
    return bytes([(0xFF00 >> (more + 1)) & 0xFF | n >> (6 * more), *tail])


# ---------------------------------------------------------------- writing


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """Mono 8-bit streams, one sample a byte (value - 128), each frame the smallest of constant, verbatim and the fixed
    predictors of order 0 to 2 with one Rice parameter; a seek point for each frame."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    base = np.concatenate([[0], np.cumsum(sizes)])
    file_of = np.repeat(np.arange(len(payloads)), -(-sizes // block))
    first = np.concatenate([[0], np.cumsum(-(-sizes // block))])
    number = np.arange(len(file_of)) - first[file_of]
    start = base[file_of] + number * block
    length = np.minimum(block, base[file_of + 1] - start)
    x = joined.astype(np.int32) - 128
    frames: list[bytes] = [b""] * len(file_of)
    by_plan: dict[tuple[int, int], list[int]] = {}
    residuals = [x, np.diff(x, prepend=0), np.diff(np.diff(x, prepend=0), prepend=0)]
    folded = [((r << 1) ^ (r >> 31)).astype(np.uint32) for r in residuals]
    best, plan = 8.0 * length + 8, np.full(len(file_of), -1)
    for order in range(3):
        if not len(file_of):
            break
        # the sum of the folded residuals bounds the unary part for any parameter: sum(u >> k) <= sum(u) >> k
        total = np.add.reduceat(folded[order], start, dtype=np.int64) - sum(folded[order][np.minimum(start + i, len(joined) - 1)] for i in range(order))
        for k in range(2, 8):
            bits = (length - order) * (k + 0.5) + total / (1 << k) + 18 + 8 * order
            better = (length > order) & (bits < best)
            best, plan = np.where(better, bits, best), np.where(better, order * 16 + k, plan)
    if len(file_of):
        constant = np.minimum.reduceat(joined, start) == np.maximum.reduceat(joined, start)
        plan = np.where(constant, -2, plan)
    for i, p in enumerate(plan.tolist()):
        by_plan.setdefault(p, []).append(i)
    for p, members in by_plan.items():
        for lo in range(0, len(members), 256):
            _write_frames(p, np.array(members[lo : lo + 256]), x, joined, folded, start, length, number, block, frames)
    if frames:
        body = np.frombuffer(b"".join(frames), np.uint8)
        ends = np.cumsum([len(f) for f in frames])
        sums = crc16_many(body, np.concatenate([[0], ends[:-1]]), ends)
        frames = [f + struct.pack(">H", c) for f, c in zip(frames, sums.tolist())]
    out = []
    for i, payload in enumerate(payloads):
        own = frames[first[i] : first[i + 1]]
        lens = [len(f) for f in own] or [0]
        bits = (44100 << 44) | (7 << 36) | len(payload)
        info = struct.pack(">HH", block, block) + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big") + bits.to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        at = [0, *np.cumsum(lens).tolist()]
        points = b"".join(struct.pack(">QQH", n * block, at[n], min(block, len(payload) - n * block)) for n in range(len(own)))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


def _write_frames(plan, members, x, joined, folded, start, length, number, block, frames) -> None:
    heads = []
    for i in members.tolist():
        n = int(length[i])
        code = BLOCK_CODES.get(n, 7)
        head = b"\xff\xf8" + bytes([code << 4, 0x02]) + _coded_number(int(number[i])) + (struct.pack(">H", n - 1) if code == 7 else b"")
        heads.append(head + bytes([crc8(head)]))
    if plan == -2:
        for i, head in zip(members.tolist(), heads):
            frames[i] = head + b"\x00" + bytes([int(joined[start[i]]) ^ 0x80])
        return
    if plan == -1:
        for i, head in zip(members.tolist(), heads):
            frames[i] = head + b"\x02" + (joined[start[i] : start[i] + length[i]] ^ 0x80).tobytes()
        return
    order, k = plan >> 4, plan & 15
    n = length[members] - order
    total = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(members)), n)
    u = folded[order][start[members][owner] + order + np.arange(total[-1]) - total[owner]].astype(np.int64)
    cost = (u >> k) + 1 + k
    ends = np.cumsum(cost)
    bits_of = ends[total[1:] - 1] - np.concatenate([[0], ends[total[1:-1] - 1]])
    lead = 8 + 8 * order + 6 + 4
    room = -(-(lead + bits_of) // 8) * 8
    bit_base = np.concatenate([[0], np.cumsum(room)])
    before = np.concatenate([[0], ends[total[1:-1] - 1]])
    at = ends - cost + (u >> k) + (bit_base[:-1] + lead - before)[owner]
    code, width = (u & ((1 << k) - 1)) | (1 << k), np.full(len(u), k + 1)
    # the frame's fixed fields are codes too: subframe type, warm-up samples, Rice parameter (method and order are zero bits)
    fixed = bit_base[:-1]
    fields = [(fixed, np.full(len(members), 0x10 | (order << 1)), 8), *((fixed + 8 + 8 * w, joined[start[members] + w].astype(np.int64) ^ 0x80, 8) for w in range(order)), (fixed + 8 + 8 * order + 6, np.full(len(members), k), 4)]
    at = np.concatenate([at, *(f[0] for f in fields)])
    code = np.concatenate([code, *(f[1] for f in fields)]).astype(np.uint64)
    width = np.concatenate([width, *(np.full(len(members), f[2]) for f in fields)])
    word, shifted = at >> 5, code << (64 - (at & 31) - width).astype(np.uint64)
    size = int(bit_base[-1] >> 5) + 2
    # codes never overlap, so sums of their words (exact below 2^53) are their bitwise or
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    packed = (np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size) + low).astype(np.uint64).astype(">u4").tobytes()
    for m, i in enumerate(members.tolist()):
        frames[i] = heads[m] + packed[bit_base[m] // 8 : bit_base[m + 1] // 8]


# ---------------------------------------------------------------- reading


def stream_info(data: bytes) -> dict:
    """Metadata of one stream, its seek points and the byte where its frames begin."""
    if data[:4] != b"fLaC":
        raise BadStream("no fLaC marker")
    at, last, info = 4, False, None
    points = []
    while not last:
        if at + 4 > len(data):
            raise BadStream("metadata cut short")
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            info = {"rate": v >> 44, "channels": ((v >> 41) & 7) + 1, "bits": ((v >> 36) & 31) + 1, "samples": v & ((1 << 36) - 1), "block": int.from_bytes(body[2:4], "big"), "md5": body[18:34]}
        elif kind == 3:
            points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, len(body), 18)]
        at += 4 + n
    if info is None:
        raise BadStream("no STREAMINFO")
    return info | {"points": [p for p in points if p[0] != (1 << 64) - 1], "at": at}


def _frame_header(buf: bytes, at: int, info: dict) -> tuple[int, int, int, int, int]:
    """(bytes, block size, channel code, bits per sample, first sample) of the frame at a byte; checks its CRC-8."""
    if buf[at : at + 1] != b"\xff" or buf[at + 1] & 0xFC != 0xF8:
        raise BadStream("no frame sync")
    size_code, rate_code, channel, depth = buf[at + 2] >> 4, buf[at + 2] & 15, buf[at + 3] >> 4, (buf[at + 3] >> 1) & 7
    p, lead = at + 5, buf[at + 4]
    value, more = lead, 0
    if lead >= 0xC0:
        more = 8 - (~lead & 0xFF).bit_length() - 1
        value = lead & (0x3F >> more)
    for _ in range(more):
        value = value << 6 | (buf[p] & 0x3F)
        p += 1
    if size_code == 6:
        n, p = buf[p] + 1, p + 1
    elif size_code == 7:
        n, p = int.from_bytes(buf[p : p + 2], "big") + 1, p + 2
    else:
        n = next(k for k, v in BLOCK_CODES.items() if v == size_code)
    p += RATE_BYTES.get(rate_code, 0)
    if crc8(buf[at:p]) != buf[p]:
        raise BadStream("frame header fails CRC-8")
    first = value if buf[at + 1] & 1 else value * info["block"]
    return p + 1 - at, n, channel, SAMPLE_BITS.get(depth, info["bits"]), first


class _Bits:
    """Big-endian bit windows at many places of one buffer at once."""

    def __init__(self, buf: bytes):
        b = np.frombuffer(buf + bytes(16), np.uint8).astype(np.uint64)
        self.words = (b[:-8] << np.uint64(56)) | (b[1:-7] << np.uint64(48)) | (b[2:-6] << np.uint64(40)) | (b[3:-5] << np.uint64(32)) | (b[4:-4] << np.uint64(24)) | (b[5:-3] << np.uint64(16)) | (b[6:-2] << np.uint64(8)) | b[7:-1]

    def window(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 valid bits from each bit position, in the upper end."""
        at = np.minimum(pos >> 3, len(self.words) - 1)
        return self.words[at] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, np.uint64), pos.shape)
        return np.where(n > 0, self.window(pos) >> (np.uint64(64) - np.maximum(n, 1)), 0).astype(np.int64)

    def signed(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v, n = self.take(pos, n), np.asarray(n, np.int64)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0)) << n), 0)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        q = np.zeros(len(pos), np.int64)
        open_ = np.arange(len(pos))
        while len(open_):
            w = self.window(pos[open_] + q[open_]) >> np.uint64(8)
            zeros = np.where(w > 0, 56 - np.frexp(w.astype(np.float64))[1], 56)
            # a double may round up to the next power of two; the top bit then tells
            zeros = np.where((w > 0) & (zeros < 56) & (w >> np.clip(55 - zeros, 0, 63).astype(np.uint64) == 0), zeros + 1, zeros)
            q[open_] += zeros
            open_ = open_[zeros == 56]
            if len(open_) and (pos[open_] + q[open_] > len(self.words) * 8).any():
                raise BadStream("a unary code runs off the end")
        return q


_LEAD16 = np.array([16] + [15 - i.bit_length() + 1 for i in range(1, 65536)], np.int64)


def _subframes(bits: _Bits, pos: np.ndarray, n: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One subframe for each place: samples (position x frame) and the bit where each ends."""
    head = bits.take(pos, 8)
    if (head >> 7).any():
        raise BadStream("subframe padding is not zero")
    kind, pos = (head >> 1) & 63, pos + 8
    wasted = np.zeros(len(pos), np.int64)
    w = np.flatnonzero(head & 1)
    if len(w):
        wasted[w] = bits.unary(pos[w]) + 1
        pos = pos.copy()
        pos[w] += wasted[w]
    depth = depth - wasted
    out = np.zeros((int(n.max()), len(pos)), np.int32)
    constant = kind == 0
    if constant.any():
        out[:, constant] = bits.signed(pos[constant], depth[constant])
    pos = np.where(constant, pos + depth, pos)
    verbatim = np.flatnonzero(kind == 1)
    if len(verbatim):
        owner = np.repeat(verbatim, n[verbatim])
        row = np.arange(len(owner)) - np.repeat(np.cumsum(n[verbatim]) - n[verbatim], n[verbatim])
        out[row, owner] = bits.signed(pos[owner] + row * depth[owner], depth[owner])
        pos[verbatim] += n[verbatim] * depth[verbatim]
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(constant | (kind == 1) | fixed | lpc)).any():
        raise BadStream("reserved subframe type")
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        order = np.where(fixed, kind - 8, kind - 31)
        _predicted(bits, pos, n, depth, order, lpc, coded, out)
    out <<= wasted
    return out, pos


def _predicted(bits, pos, n, depth, order, lpc, coded, out) -> None:
    coded = coded[np.argsort(-n[coded], kind="stable")]  # the frames still going are a prefix at each position
    top = int(order[coded].max())
    for i in range(top):
        live = coded[order[coded] > i]
        out[i, live] = bits.signed(pos[live], depth[live])
        pos[live] += depth[live]
    taps, shift = np.zeros((max(top, 1), len(coded)), np.int64), np.zeros(len(coded), np.int64)
    for c, f in enumerate(coded.tolist()):
        if not lpc[f]:
            taps[: order[f], c] = FIXED[order[f]]
    l = np.flatnonzero(lpc[coded])
    if len(l):
        f = coded[l]
        width = bits.take(pos[f], 4) + 1
        shift[l] = bits.signed(pos[f] + 4, 5)
        pos[f] += 9
        for i in range(int(order[f].max())):
            m = order[f] > i
            taps[i, l[m]] = bits.signed(pos[f[m]], width[m])
            pos[f[m]] += width[m]
    method = bits.take(pos[coded], 2)
    if (method > 1).any():
        raise BadStream("reserved residual coding")
    width = np.where(method == 0, 4, 5)
    partitions = bits.take(pos[coded] + 2, 4)
    pos[coded] += 6
    p, length, o = pos[coded], n[coded], order[coded]
    each = length >> partitions
    turn = o.copy()  # position at which each frame's next partition starts; the first one begins after the warm-up
    part = np.zeros(len(coded), np.int64)
    k, raw = np.zeros(len(coded), np.int64), np.full(len(coded), -1)
    res = np.zeros((int(length.max()), len(coded)), np.int32)
    lengths = -length  # ascending, for the count of frames still going
    any_raw, wide, due = False, False, int(o.min())
    for i in range(int(o.min()), int(length[0])):
        live = int(np.searchsorted(lengths, -i, "left"))
        if i >= due:
            t = np.flatnonzero((turn[:live] == i) & (o[:live] <= i))
            k[t] = bits.take(p[t], width[t])
            p[t] += width[t]
            escape = k[t] == (1 << width[t]) - 1
            raw[t] = np.where(escape, bits.take(p[t], 5), -1)
            p[t] += np.where(escape, 5, 0)
            k[t] = np.where(escape, 0, k[t])
            part[t] += 1
            turn[t] = np.where(part[t] >> partitions[t], length[t] + 1, part[t] * each[t])
            empty = turn[t] <= i  # a first partition that holds only warm-up samples
            if empty.any():
                raise BadStream("partition shorter than the predictor")
            any_raw, wide, due = bool((raw >= 0).any()), int(k.max()) > 24, int(turn.min(initial=1 << 40, where=turn > i))
        q = p[:live]
        window = bits.words[q >> 3] << (q & 7).astype(np.uint64)
        zeros = _LEAD16[(window >> np.uint64(48)).astype(np.int64)]
        far = np.flatnonzero((zeros == 16) | (zeros + k[:live] >= 40)) if wide else np.flatnonzero(zeros == 16)
        wait = o[:live] > i if i < top else None
        low = ((window << (zeros + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - k[:live]).astype(np.uint64)
        value = (zeros << k[:live]) | low.astype(np.int64)
        step = zeros + 1 + k[:live]
        if len(far):
            zf = bits.unary(q[far])
            value[far] = (zf << k[far]) | bits.take(q[far] + zf + 1, k[far])
            step[far] = zf + 1 + k[far]
        value = (value >> 1) ^ -(value & 1)
        if any_raw:
            r = np.flatnonzero(raw[:live] >= 0)
            value[r] = bits.signed(q[r], raw[r])
            step[r] = raw[r]
        if wait is not None and wait.any():
            value[wait], step[wait] = 0, 0
        res[i, :live] = value
        p[:live] += step
    pos[coded] = p
    for o_ in np.unique(o).tolist():
        same = np.flatnonzero((o == o_) & ~lpc[coded])
        if len(same):
            out[: len(res), coded[same]] = _integrate(res[:, same], out[:o_, coded[same]])
    rest = np.flatnonzero(lpc[coded])
    if len(rest):
        f, a, s = coded[rest], taps[:, rest], shift[rest]
        for i in range(int(o[rest].min()), int(length[rest].max())):
            guess = sum(a[j] * (out[i - 1 - j, f].astype(np.int64) if i > j else 0) for j in range(int(o[rest].max())))
            now = (o[rest] <= i) & (length[rest] > i)
            out[i, f] = np.where(now, res[i, rest] + (guess >> s), out[i, f])


def _integrate(y: np.ndarray, warm: np.ndarray) -> np.ndarray:
    """Samples from their differences of order len(warm), one order at a time, each started by the warm-up samples."""
    o = len(warm)
    for d in range(o, 0, -1):
        y[o - 1] = np.diff(warm, d - 1, axis=0)[-1]
        y[o - 1 :] = np.cumsum(y[o - 1 :], axis=0)
    y[:o] = warm
    return y


def decode(streams: list[bytes], check: bool = True) -> list[tuple[dict, list[tuple[int, int, np.ndarray]]]]:
    """Per stream: metadata and its frames as (first sample, byte offset, samples of shape (n, channels)), in order."""
    infos = [stream_info(s) for s in streams]
    buf = b"".join(streams)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).tolist()
    bits, raw = _Bits(buf), np.frombuffer(buf, np.uint8)
    found: list[list] = [[] for _ in streams]
    waiting: list[tuple[int, int]] = []
    whole = []
    for i, info in enumerate(infos):
        covered = sum(p[2] for p in info["points"])
        whole.append(bool(info["points"]) and covered == info["samples"])
        begin = base[i] + info["at"]
        if whole[i]:
            waiting += [(i, begin + p[1]) for p in info["points"]]
        elif begin < base[i + 1]:
            waiting.append((i, begin))
    while waiting:
        after: list[tuple[int, int]] = []
        for lo in range(0, len(waiting), 2048):
            now = waiting[lo : lo + 2048]
            heads = [_frame_header(buf, at, infos[i]) for i, at in now]
            ends = _decode_wave(bits, raw, now, heads, infos, base, found, check)
            after += [(i, e) for (i, _), e in zip(now, ends) if not whole[i] and e < base[i + 1]]
        waiting = after
    out = []
    for i, info in enumerate(infos):
        frames = sorted(found[i], key=lambda f: f[0])
        if check and info["samples"] and sum(len(f[2]) for f in frames) != info["samples"]:
            raise BadStream("samples are missing")
        out.append((info, frames))
    return out


def _decode_wave(bits, raw, now, heads, infos, base, found, check) -> list[int]:
    at = np.array([a for _, a in now])
    n = np.array([h[1] for h in heads])
    code = np.array([h[2] for h in heads])
    depth = np.array([h[3] for h in heads])
    pos = (at + np.array([h[0] for h in heads])) * 8
    channels = np.where(code < 8, code + 1, 2)
    parts = []
    for c in range(int(channels.max())):
        live = np.flatnonzero(channels > c)
        side = ((code[live] == 8) & (c == 1)) | ((code[live] == 9) & (c == 0)) | ((code[live] == 10) & (c == 1))
        got, pos[live] = _subframes(bits, pos[live], n[live], depth[live] + side)
        parts.append((live, got))
    ends = -(-pos // 8) + 2
    if (ends > np.array([base[i + 1] for i, _ in now])).any():
        raise BadStream("frame cut short")
    if check:
        sums = crc16_many(raw, at, ends - 2)
        if (sums != raw[ends - 2].astype(np.uint16) * 256 + raw[ends - 1]).any():
            raise BadStream("frame fails CRC-16")
    where = [{f: j for j, f in enumerate(live.tolist())} for live, _ in parts]
    for f, ((i, a), h) in enumerate(zip(now, heads)):
        x = np.stack([parts[c][1][: h[1], where[c][f]] for c in range(int(channels[f]))], 1)
        if h[2] == 8:
            x[:, 1] = x[:, 0] - x[:, 1]
        elif h[2] == 9:
            x[:, 0] = x[:, 0] + x[:, 1]
        elif h[2] == 10:
            mid = (x[:, 0] << 1) | (x[:, 1] & 1)
            x = np.stack([(mid + x[:, 1]) >> 1, (mid - x[:, 1]) >> 1], 1)
        found[i].append((h[4], int(a - base[i] - infos[i]["at"]), x))
    return ends.tolist()


# ---------------------------------------------------------------- Spark

#: What reading a damaged stream can raise: a failed check, or bytes that end too early.
_BROKEN = (BadStream, IndexError, StopIteration, struct.error)


def read_block(streams: list[bytes], offsets: list[int], ends: list[int] | None = None) -> list[np.ndarray]:
    """The block of each stream whose frame begins at this byte offset (as its block row says), of shape (n, channels). Only the bytes up
    to `ends` (the next block's offset; the stream's end where not given) are read, no frame before or after."""
    infos = [stream_info(s) for s in streams]
    cut = [s[i["at"] + a : None if ends is None else i["at"] + e] for s, i, a, e in zip(streams, infos, offsets, ends or offsets)]
    buf = b"".join(cut)
    base = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).tolist()
    bits, raw = _Bits(buf), np.frombuffer(buf, np.uint8)
    found: list[list] = [[] for _ in streams]
    for lo in range(0, len(streams), 2048):
        now = [(i, base[i]) for i in range(lo, min(lo + 2048, len(streams)))]
        _decode_wave(bits, raw, now, [_frame_header(buf, at, infos[i]) for i, at in now], infos, base, found, True)
    return [f[0][2] for f in found]


def block_rows(streams: list[bytes]) -> list[list[tuple]]:
    """Per stream its PCM blocks in order: (block, sample_offset, byte_offset, n_samples, channels, bits, pcm, ok, error). The streams are
    decoded side by side; where one fails a check, each is decoded alone and the bad ones give one row without samples."""
    try:
        read = decode(streams)
    except _BROKEN as e:
        if len(streams) > 1:
            return [rows for s in streams for rows in block_rows([s])]
        return [[(0, 0, 0, 0, None, None, None, False, str(e) or type(e).__name__)]]
    return [[(j, s, a, len(x), info["channels"], info["bits"], x.astype("<i4").tobytes(), True, None) for j, (s, a, x) in enumerate(frames)] for info, frames in read]


def decode_column(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """PCM blocks: key, block, sample_offset, byte_offset, n_samples, channels, bits, pcm (little-endian 32-bit samples),
    ok, error. A stream that fails a check gives one row with ok false and no samples; null media give no row."""
    ship(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, block int, sample_offset long, byte_offset long, n_samples int, channels int, bits int, pcm binary, ok boolean, error string"
    names = [key, "block", "sample_offset", "byte_offset", "n_samples", "channels", "bits", "pcm", "ok", "error"]

    def run(batches):
        for batch in text_chunks(batches, column):
            there = [(k, data) for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if data is not None]
            rows = [(k, *row) for (k, _), found in zip(there, block_rows([data for _, data in there])) for row in found]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, kinds)], names)

    return media.select(key, column).mapInArrow(run, schema)


def _feature(x: np.ndarray) -> str:
    """Peak, mean magnitude in thousandths and sign changes of the samples read back."""
    return f"peak={int(np.abs(x).max())};mean={int(np.abs(x).sum()) * 1000 // len(x)};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text as an 8-bit stream and what reading it back gives: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, n_frames, tail_offset. The samples are those of the stream's PCM blocks; the tail is
    read by a seek to the byte offset of the last block (tail_offset), which must agree. Null text is empty; each row stands alone."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "tail_offset"]

    def run(batches):
        for batch in text_chunks(batches, max_bytes=12 << 20):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            streams = encode([t + bytes(max(64, -(-len(t) // 64) * 64) - len(t)) for t in texts])
            blocks = block_rows(streams)
            if bad := [b[0][-1] for b in blocks if not b[0][-2]]:
                raise BadStream(bad[0])
            sought = read_block(streams, [b[-1][2] for b in blocks])
            rows = []
            for text, stream, parts, block in zip(texts, streams, blocks, sought):
                x = np.frombuffer(b"".join(p[6] for p in parts), "<i4")
                back = (x + 128).astype(np.uint8).tobytes()
                if hashlib.md5((np.frombuffer(back, np.uint8) ^ 0x80).tobytes()).digest() != stream_info(stream)["md5"]:
                    raise BadStream("samples fail the stream's MD5")
                tail = (block[:, 0] + 128).astype(np.uint8).tobytes()
                if parts[-1][1] + len(tail) != len(back) or not back.endswith(tail):
                    raise BadStream("the sought block is not the last one")
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(tail[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), _feature(x), len(parts), parts[-1][2]))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, tail_offset long")
