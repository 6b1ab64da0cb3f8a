"""The reader of MPEG audio on streams of every version and layer, with tables and tags of each kind."""

import random
import struct

import pytest

from riftline.llm.mpeg import KILOBITS, SAMPLES_A_SECOND, checksum, parsed, read_stream, read_tags, syncsafe, text_frame

VERSION_BITS, LAYER_BITS = {1: 3, 2: 2, 2.5: 0}, {1: 3, 2: 2, 3: 1}


def head(version, layer, index, rate, stereo, protected=False, padded=False):
    return bytes((0xFF, 0xE0 | VERSION_BITS[version] << 3 | LAYER_BITS[layer] << 1 | (not protected), index << 4 | rate << 2 | padded << 1, 0x00 if stereo else 0xC0))


def frame(h, rng, start=b""):
    x = parsed(h)
    body = bytes(rng.randrange(0, 255) for _ in range(x.size - 4 - len(start)))  # never 255: no false header
    if x.protected and x.layer == 3:
        body = struct.pack(">H", checksum(h[2:] + body[2 : 2 + x.side])) + body[2:]
    return h + start + body


@pytest.mark.parametrize("stereo", [False, True])
@pytest.mark.parametrize("layer", [1, 2, 3])
@pytest.mark.parametrize("version", [1, 2, 2.5])
def test_all_kinds_of_frames(version, layer, stereo):
    rng = random.Random(str((version, layer, stereo)))
    for rate in range(3):
        frames = [frame(head(version, layer, rng.randint(2, 14), rate, stereo, rng.random() < 0.5, rng.random() < 0.5), rng) for _ in range(12)]
        junk = bytes(rng.randrange(0, 255) for _ in range(77))
        s = read_stream(junk + b"".join(frames[:5]) + junk + b"".join(frames[5:]))
        sizes = [len(f) for f in frames]
        want = [77 + sum(sizes[:k]) + 77 * (k >= 5) for k in range(12)]
        samples = {1: 384, 2: 1152, 3: 1152 if version == 1 else 576}[layer]
        # the frame before junk only counts where its checksum holds
        lost = [] if parsed(frames[4][:4]).protected and layer == 3 else [want[4]]
        assert s.offsets == [w for w in want if w not in lost] and s.wrong == 0
        assert s.samples == samples * len(s.offsets) and s.sample_rate == SAMPLES_A_SECOND[version][rate]
        assert s.duration == pytest.approx(samples * 1000 / SAMPLES_A_SECOND[version][rate] * len(s.offsets))


def test_known_sizes():
    assert parsed(head(1, 3, 9, 0, True)).size == 417 and parsed(head(1, 3, 9, 0, True, padded=True)).size == 418  # 128 kbit/s at 44.1 kHz
    assert parsed(head(1, 1, 12, 1, True)).size == 384 and parsed(head(1, 2, 10, 1, True)).size == 576 and parsed(head(2, 3, 8, 0, False)).size == 208
    assert all(len(k) == 14 and list(k) == sorted(k) for k in KILOBITS.values())
    for bad in (b"\xff\xe9\x90\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xf9\x90", b"\xfe\xfb\x90\x00", b"\xff\xf1\x90\x00"):
        assert parsed(bad) is None


@pytest.mark.parametrize("stereo", [False, True])
@pytest.mark.parametrize("version", [1, 2, 2.5])
def test_tables(version, stereo):
    rng = random.Random(7)
    h = head(version, 3, 12, 0, stereo)
    frames = [frame(head(version, 3, k + 4, 0, stereo), rng) for k in range(6)]
    side = bytes(parsed(h).side)
    xing = frame(h, rng, side + b"Xing" + struct.pack(">III", 7, 6, 4321) + bytes(range(100)))
    s = read_stream(xing + b"".join(frames))
    assert s.table == (6, 4321) and s.seek_points == bytes(range(100)) and len(s.offsets) == 6 and s.offsets[0] == len(xing)
    short = frame(h, rng, side + b"Info" + struct.pack(">II", 1, 6))
    assert read_stream(short + b"".join(frames)).table == (6, 0)
    vbri = frame(h, rng, bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 999, 6, 3, 1, 2, 2) + b"\x00\x01\x00\x02\x00\x03")
    s = read_stream(vbri + b"".join(frames))
    assert s.table == (6, 999) and s.seek_points == b"\x00\x01\x00\x02\x00\x03" and len(s.offsets) == 6


def test_tags_of_each_version():
    four = lambda name, b: name + syncsafe(len(b)) + b"\x00\x00" + b
    long = b"\x03" + ("é日" * 60).encode()
    body = four(b"TIT2", long) + four(b"TALB", b"\x01" + "naïve".encode("utf-16")) + four(b"APIC", b"\x00\xff\xfb\x90\x00") + four(b"TPE1", b"\x02" + "x".encode("utf-16-be"))
    tag = b"ID3\x04\x00\x10" + syncsafe(len(body)) + body
    media = tag + b"3DI\x04\x00\x10" + syncsafe(len(body)) + b"audio"
    tags, begin, end = read_tags(media)
    assert tags == {"TIT2": "é日" * 60, "TALB": "naïve", "TPE1": "x"} and media[begin:end] == b"audio"
    three = text_frame(b"TIT2", "old") + bytes(20)
    extended = b"ID3\x03\x00\x40" + syncsafe(len(three) + 10) + struct.pack(">IHI", 6, 0, 0) + three
    assert read_tags(extended + b"x")[:2] == ({"TIT2": "old"}, len(extended))
    two = b"TT2" + (4).to_bytes(3, "big") + b"\x00abc"
    assert read_tags(b"ID3\x02\x00\x00" + syncsafe(len(two)) + two)[0] == {"TT2": "abc"}
    stuffed = text_frame(b"TIT2", "ÿa").replace(b"\xff", b"\xff\x00")
    assert read_tags(b"ID3\x03\x00\x80" + syncsafe(len(stuffed)) + stuffed)[0] == {"TIT2": "ÿa"}
    for broken in (b"", b"ID3", b"ID3\x04\x00\x00\x7f\x7f\x7f\x7fTIT2\x7f\x7f\x7f\x7f", b"TAG"):
        read_stream(broken)


def test_wrong_checksums_are_counted():
    rng = random.Random(3)
    frames = [bytearray(frame(head(1, 3, 9, 0, True, protected=True), rng)) for _ in range(4)]
    frames[2][10] ^= 1
    s = read_stream(b"".join(map(bytes, frames)))
    assert len(s.offsets) == 4 and s.wrong == 1 and s.duration == pytest.approx(4 * 1152 * 1000 / 44100)
