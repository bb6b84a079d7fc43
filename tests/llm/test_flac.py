import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import flac


def samples(frames):
    return np.concatenate([f[2][:, 0] for f in frames]) if frames else np.zeros(0, int)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=64, max_size=300), st.integers(0, 255).map(lambda b: bytes([b]) * 200), st.integers(0, 2**32 - 1).map(lambda s: np.cumsum(np.random.default_rng(s).integers(-3, 4, 9000)).astype(np.uint8).tobytes())), min_size=1, max_size=6))
def test_round_trip(payloads):
    for payload, (info, frames) in zip(payloads, flac.decode(flac.encode(payloads))):
        assert (samples(frames) + 128).astype(np.uint8).tobytes() == payload and info["samples"] == len(payload)
        at = 0
        for first, _, x in frames:
            assert first == at
            at += len(x)


class Writer:
    """A plain bit writer, to make streams that the encoder does not."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, k):
        u = v << 1 if v >= 0 else (-v << 1) - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        b = self.bits + "0" * (-len(self.bits) % 8)
        return int(b, 2).to_bytes(len(b) // 8, "big")


def crc16(data):
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def stream(subframes, n, channel, bits=16, channels=2, points=b""):
    """One frame of given subframes (writers) in a stream without a seek table."""
    head = b"\xff\xf8" + bytes([0x70, channel << 4 | {8: 1, 16: 4}[bits] << 1]) + b"\x00" + (n - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    body = Writer()
    for s in subframes:
        body.bits += s
    frame = head + body.bytes()
    frame += crc16(frame).to_bytes(2, "big")
    info = (n.to_bytes(2, "big") * 2) + bytes(6) + ((44100 << 44) | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def lpc(x, coefs, shift, k=3, depth=16, partitions=1, escape=False):
    w, p = Writer(), len(coefs)
    w.put((32 + p - 1) << 1, 8)
    for v in x[:p]:
        w.put(v, depth)
    w.put(5 - 1, 4)
    w.put(shift, 5)
    for c in coefs:
        w.put(c, 5)
    w.put(0, 2)
    w.put(partitions, 4)
    each = len(x) >> partitions
    for q in range(1 << partitions):
        raw = escape and q == 1
        w.put(15 if raw else k, 4)
        if raw:
            w.put(9, 5)
        for i in range(max(q * each, p), (q + 1) * each):
            r = x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift)
            w.put(r, 9) if raw else w.rice(r, k)
    return w.bits


def verbatim(x, depth=16):
    w = Writer()
    w.put(2, 8)
    for v in x:
        w.put(v, depth)
    return w.bits


@pytest.mark.parametrize("escape", [False, True])
def test_linear_prediction_partitions_and_stereo(escape):
    rng = np.random.default_rng(3)
    left = np.cumsum(rng.integers(-5, 6, 64)).tolist()
    right = np.cumsum(rng.integers(-5, 6, 64)).tolist()
    a = lpc(left, [7, -3, 1], 2, escape=escape)
    plain = stream([a, verbatim(right)], 64, 1)
    side = stream([a, verbatim([x - y for x, y in zip(left, right)], 17)], 64, 8)
    mid = stream([verbatim([(x + y) >> 1 for x, y in zip(left, right)]), verbatim([x - y for x, y in zip(left, right)], 17)], 64, 10)
    for data in (plain, side, mid):
        (_, frames), = flac.decode([data])
        assert frames[0][2].tolist() == [list(v) for v in zip(left, right)]
    three = flac.decode([plain, side, mid])
    assert [len(f) for _, f in three] == [1, 1, 1]


def test_long_unary_runs_and_orders_side_by_side():
    x = [0, 4000, -4000, 1, 2, 3, 4, 5]
    w = Writer()
    w.put((8 + 1) << 1, 8)
    w.put(x[0], 16)
    w.put(0, 6)
    w.put(0, 4)
    for a, b in zip(x, x[1:]):
        w.rice(b - a, 0)
    s = stream([w.bits], 8, 0, channels=1)
    assert samples(flac.decode([s])[0][1]).tolist() == x


def test_damage_is_found():
    data = bytearray(flac.encode([bytes(range(200)) * 30])[0])
    for at in (len(data) - 1, len(data) - 40, len(data) // 2):
        bad = bytes(data[:at]) + bytes([data[at] ^ 4]) + bytes(data[at + 1 :])
        with pytest.raises((flac.BadStream, IndexError)):
            flac.decode([bad])
    for cut in (3, 30, len(data) - 3):
        with pytest.raises((flac.BadStream, IndexError)):
            flac.decode([bytes(data[:cut])])


def test_columns(spark, odd_docs, no_docs):
    good = flac.encode([b"x" * 5000, bytes(range(256)) * 20])
    df = spark.createDataFrame([(1, good[0]), (2, good[1]), (3, None), (4, b"junk"), (5, good[0][:-1])], "media_id long, media binary")
    rows = flac.decode_column(df).orderBy("media_id", "block").collect()
    assert [(r.media_id, r.sample_offset, r.n_samples, r.ok) for r in rows] == [(1, 0, 4096, True), (1, 4096, 904, True), (2, 0, 4096, True), (2, 4096, 1024, True), (4, 0, 0, False), (5, 0, 0, False)]
    pcm = np.frombuffer(b"".join(r.pcm for r in rows if r.media_id == 2), "<i4")
    assert (pcm + 128).astype(np.uint8).tobytes() == bytes(range(256)) * 20
    assert flac.text_media(no_docs).count() == 0
    texts = sorted(((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()), key=str)
    got = sorted(flac.text_media(odd_docs).collect(), key=lambda r: str((r.doc_id, r.n_bytes)))
    want = []
    for i, t in texts:
        p = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        want.append((i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == sorted(map(str, want))


def test_a_block_is_read_by_its_offset():
    payloads = [bytes(range(256)) * 70, b"abc" * 4096, b"z" * 64, np.random.default_rng(1).integers(0, 256, 9000, dtype=np.uint8).tobytes()]
    streams = flac.encode(payloads)
    rows = flac.block_rows(streams)
    assert [r[1] for r in rows[0]] == [4096 * j for j in range(5)] and all(r[-2] for found in rows for r in found)
    for j in range(5):
        for i, found in enumerate(rows):
            if j < len(found):
                n, at, n_samples, pcm = found[j][1], found[j][2], found[j][3], found[j][6]
                end = found[j + 1][2] if j + 1 < len(found) else len(streams[i])
                alone = streams[i][: flac.stream_info(streams[i])["at"] + end]  # nothing after the block is there
                (x,) = flac.read_block([alone], [at], [end])
                assert x[:, 0].astype("<i4").tobytes() == pcm and (x[:, 0] + 128).astype(np.uint8).tobytes() == payloads[i][n : n + n_samples]
    last = flac.read_block(streams, [found[-1][2] for found in rows])
    assert [(x[:, 0] + 128).astype(np.uint8).tobytes()[-64:] for x in last] == [p[-64:] for p in payloads]
    with pytest.raises((flac.BadStream, IndexError)):
        flac.read_block(streams[:1], [rows[0][2][2] + 1])


def test_one_bad_stream_leaves_the_others_of_its_chunk():
    good = flac.encode([b"y" * 100, b"x" * 200])
    rows = flac.block_rows([good[0], b"fLaC", good[1]])
    assert [[r[-2] for r in found] for found in rows] == [[True], [False], [True]] and [found[0][3] for found in rows] == [100, 0, 200]
