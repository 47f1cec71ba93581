"""Media columns: MPEG audio streams with tags, a variable-bitrate table, checksums, durations and seek offsets.

``mux`` stores bytes without loss as the main data of MPEG-1 Layer III frames with checksums, behind an ID3v2 tag and an
information frame (frame count, byte count, 100-step seek table). ``probe`` reads any such stream: it parses the tags,
resynchronises on frame headers whose successors fit, whatever garbage stands between, verifies the CRC-16 of protected
frames of all versions and channel modes, reads Xing, Info and VBRI tables, and returns the exact duration in samples
and the byte offset of every frame, as differences. Frames that can't be verified (unprotected or too short) are counted
apart from bad ones. All work on frames of a stream is done on numpy columns.

Defined cases: null or empty content is a stream of one payload frame of 64 zero bytes; a null media value has no frame;
rows are handled one by one, whatever their ids; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import runs
from .common import documents

# Fixed values of the format: kbit/s by index for versions 1 and 2 (and 2.5) of layer III, samples a second by version.
RATES_1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0]
RATES_2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0]
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
SIDE = 32  # bytes of side information of what mux() makes: version 1, two channels
HEAD = 4 + 2 + SIDE
VBRI_AT = 36  # from the start of the frame, whatever its side information

_crc = np.zeros(256, np.uint16)
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ CRC_POLYNOMIAL if _c & 0x8000 else _c << 1) & 0xFFFF
    _crc[_i] = _c


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of a byte matrix."""
    c = np.full(len(rows), CRC_START, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _crc[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def frame_table() -> np.ndarray:
    """(length, samples, hertz) for each value of the three bytes of a header after the first; 0 where it is no layer III header."""
    out = np.zeros((1 << 11, 3), np.int64)  # version 2 bits, rate 4 bits, hertz 2 bits, padding 1 bit, channel mode 2 bits
    for v in (3, 2, 0):
        for r in range(1, 15):
            for h in range(3):
                for p in range(2):
                    hz, kbit = HERTZ[v][h], (RATES_1 if v == 3 else RATES_2)[r]
                    samples = 1152 if v == 3 else 576
                    n = samples // 8 * kbit * 1000 // hz + p
                    out[(v << 9 | r << 5 | h << 3 | p << 2) + np.arange(4)] = n, samples, hz
    return out


FRAMES = frame_table()


def header_code(b1, b2, b3):
    """Index into FRAMES, or 0 for no header: sync bits, layer III, and the fields' bits."""
    ok = ((b1 & 0xE0) == 0xE0) & ((b1 & 0x06) == 0x02)
    return np.where(ok, (b1 >> 3 & 3).astype(np.int64) << 9 | (b2 >> 4).astype(np.int64) << 5 | (b2 >> 2 & 3) << 3 | (b2 >> 1 & 1) << 2 | b3 >> 6, 0)


def side_sizes(code: np.ndarray) -> np.ndarray:
    """Bytes of side information by header code: 32 and 17 in version 1, 17 and 9 else, the lesser for one channel."""
    first, mono = code >> 9 == 3, (code & 3) == 3
    return np.where(first, np.where(mono, 17, 32), np.where(mono, 9, 17))


def read_info(frame: bytes, side: int, protected: bool) -> dict:
    """The table of a variable-bitrate frame, Xing, Info or VBRI, or nothing: what it says of frames, bytes and steps."""
    num = lambda at, n: int.from_bytes(frame[at : at + n], "big")
    at = 4 + 2 * protected + side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out, flags, at = {"kind": frame[at : at + 4].decode()}, num(at + 4, 4), at + 8
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name], at = list(frame[at : at + n]) if name == "toc" else num(at, n), at + n
        return {**out, "payload": num(at, 8)}
    if frame[VBRI_AT : VBRI_AT + 4] == b"VBRI":
        entries, scale, size = (num(VBRI_AT + k, 2) for k in (18, 20, 22))
        steps = [num(VBRI_AT + 26 + k * size, size) * scale for k in range(entries)]
        return {"kind": "VBRI", "bytes": num(VBRI_AT + 10, 4), "frames": num(VBRI_AT + 14, 4), "frames_a_step": num(VBRI_AT + 24, 2), "steps": steps}
    return {}


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3(frames: dict[str, str]) -> bytes:
    body = b""
    for key, value in frames.items():
        text = b"\x03" + value.encode()
        body += key.encode() + synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + synchsafe(len(body)) + body


def seal(frames: np.ndarray) -> None:
    """Write the checksum of the header's last two bytes and the side information into each frame of a byte matrix."""
    c = crc16(np.concatenate([frames[:, 2:4], frames[:, 6:HEAD]], axis=1))
    frames[:, 4], frames[:, 5] = c >> 8, c & 0xFF


def blank(n: int, rate: int) -> np.ndarray:
    """n protected frames of 48 kHz, version 1, two channels, whose length is a rate's; main data is zero."""
    f = np.zeros((n, 144 * RATES_1[rate] * 1000 // 48000), np.uint8)
    f[:, 0], f[:, 1], f[:, 2] = 0xFF, 0xFA, rate << 4 | 1 << 2
    return f


def mux(payload: bytes, title: str = "payload") -> bytes:
    """A stream whose frames' main data is the payload: frames of the largest rate, then the smallest that holds the rest."""
    room = lambda rate: 144 * RATES_1[rate] * 1000 // 48000 - HEAD
    n, rest = divmod(len(payload), room(14))
    body = blank(n, 14)
    if n:
        body[:, HEAD:] = np.frombuffer(payload[: n * room(14)], np.uint8).reshape(n, -1)
        body[:, 6:HEAD] = np.frombuffer(hashlib.sha256(payload).digest(), np.uint8)
        seal(body)
    last = b""
    if rest:
        rate = next(r for r in range(1, 15) if room(r) >= rest)
        f = blank(1, rate)
        f[0, HEAD : HEAD + rest] = np.frombuffer(payload[-rest:], np.uint8)
        f[0, 6:HEAD] = np.frombuffer(hashlib.sha256(payload).digest(), np.uint8)
        seal(f)
        last = f.tobytes()
    info = blank(1, 9)
    frames, size = n + bool(rest), info.shape[1] + body.size + len(last)
    where = np.r_[info.shape[1] + np.arange(n, dtype=np.int64) * body.shape[1], [size - len(last)] * bool(rest)]
    toc = (where[np.arange(100) * frames // 100] * 256 // size).clip(0, 255).astype(np.uint8) if frames else np.zeros(100, np.uint8)
    tag = b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + size.to_bytes(4, "big") + toc.tobytes() + len(payload).to_bytes(8, "big")
    info[0, HEAD : HEAD + len(tag)] = np.frombuffer(tag, np.uint8)
    seal(info)
    return id3({"TIT2": title, "TSSE": "tallyspark"}) + info.tobytes() + body.tobytes() + last


@dataclass
class Stream:
    """What a stream holds; offsets, lengths, good and checked are columns over its frames, the information frame left
    out. A frame is good unless its checksum is wrong; checked tells whether there was one to verify."""

    tags: dict[str, str] = field(default_factory=dict)
    info: dict = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    good: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    checked: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    samples: int = 0
    hertz: int = 0
    skipped: int = 0  # bytes between frames that are no tag

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of a leading ID3v2 tag of version 3 or 4, and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, tags = min(len(data), 10 + size(data[6:10])), 10, {}
    while at + 10 <= end and data[at : at + 1].isalpha():
        n = size(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if data[at : at + 1] == b"T" and n:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[at + 10], "utf-8")
            tags[data[at : at + 4].decode("latin-1")] = data[at + 11 : at + 10 + n].decode(code, "replace").rstrip("\0")
        at += 10 + n
    return tags, end


def probe(data: bytes | None) -> Stream:
    out = Stream()
    if not data:
        return out
    out.tags, at = read_tags(data)
    b = np.frombuffer(data, np.uint8)
    end = len(b) - 128 if data[-128:-125] == b"TAG" else len(b)
    # headers at every 0xFF byte, each with the length of its frame
    ff = np.flatnonzero(b[at : max(at, end - 3)] == 0xFF) + at
    code = header_code(b[ff + 1], b[ff + 2], b[ff + 3])
    ff, code = ff[FRAMES[code, 0] > 0], code[FRAMES[code, 0] > 0]
    after = ff + FRAMES[code, 0]
    # a frame fits if another header or the end follows it
    fits = (after == end) | ((k := np.searchsorted(ff, after)) < len(ff)) & (np.r_[ff, -1][np.minimum(k, len(ff))] == after)
    chain, i = [], 0
    while i < len(ff):
        # a frame is taken if it fits, or if it stands where the last one ended and is of its version and sampling rate
        last = chain[-1] if chain else -1
        if after[i] <= end and (fits[i] or chain and ff[i] == after[last] and not (code[i] ^ code[last]) & 0b11000011000):
            out.skipped += int(ff[i] - (after[chain[-1]] if chain else at))
            chain.append(i)
            i = int(k[i])
        else:
            i += 1
    if not chain:
        out.skipped = end - at
        return out
    c = np.array(chain)
    out.skipped += int(end - after[c[-1]])
    offsets, lengths = ff[c], FRAMES[code[c], 0]
    protected, side = (b[offsets + 1] & 1) == 0, side_sizes(code[c])
    checked = protected & (lengths >= 6 + side)
    good = np.ones(len(c), bool)
    for n in np.unique(side[checked]).tolist():
        some = np.flatnonzero(checked & (side == n))
        o = offsets[some]
        good[some] = crc16(b[o[:, None] + np.r_[2, 3, 6 : 6 + n]]) == (b[o + 4].astype(np.uint16) << 8 | b[o + 5])
    first = int(offsets[0])
    out.info = read_info(data[first : first + int(lengths[0])], int(side[0]), bool(protected[0]))
    if out.info:
        c, offsets, lengths, good, checked = c[1:], offsets[1:], lengths[1:], good[1:], checked[1:]
    out.offsets, out.lengths, out.good, out.checked = offsets, lengths, good, checked
    out.samples = int(FRAMES[code[c], 1].sum())
    out.hertz = int(FRAMES[code[chain[0]], 2])
    return out


def demux(data: bytes, s: Stream) -> bytes:
    """The payload of a stream that mux() made."""
    b = np.frombuffer(data, np.uint8)
    if not len(s.offsets):
        return b""
    cut, parts = np.flatnonzero(np.diff(s.lengths)) + 1, []
    for o, n in zip(np.split(s.offsets, cut), np.split(s.lengths, cut)):
        parts.append(b[o[:, None] + np.arange(HEAD, n[0])].tobytes())
    return b"".join(parts)[: s.info.get("payload")]


def padded(content: bytes) -> bytes:
    return content + bytes(-len(content) % 64 or (0 if content else 64))


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each row's whole text, padded to a positive multiple of 64 bytes, as an audio stream."""

    def each(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for s, e in runs([len(t) + 500 for t in texts], 8_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array([len(t) for t in texts[s:e]], pa.int64()), pa.array([mux(padded(t)) for t in texts[s:e]], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_bytes long, media binary")


PROBED = "doc_id long, n_bytes long, media binary, payload binary, tail_crc32 long, title string, n_frames long, n_bad_frames long, n_unchecked_frames long, skipped_bytes long, samples long, hertz int, vbr_frames long, offset_deltas array<int>"


def probe_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> what the stored streams hold; offset_deltas: the byte offset of each frame less that of
    the one before, so that their running sum seeks to any frame."""

    def each(batches):
        for b in batches:
            stored = b.column(2)
            for s, e in runs([len(x) + 500 if x is not None else 500 for x in stored.to_pylist()], 8_000_000):
                cols = [[] for _ in range(11)]
                for data in stored.slice(s, e - s).to_pylist():
                    p = probe(data)
                    payload = demux(data or b"", p)
                    for c, v in zip(cols, (payload, zlib.crc32(payload[-64:]), p.tags.get("TIT2"), len(p.offsets), int((~p.good).sum()), int((~p.checked).sum()), p.skipped, p.samples, p.hertz, p.info.get("frames"), np.diff(p.offsets, prepend=0).astype(np.int32))):
                        c.append(v)
                types = [pa.binary(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), stored.slice(s, e - s), *(pa.array(c, t) for c, t in zip(cols, types))], [x.split()[0] for x in PROBED.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(each, PROBED)


def seek_points(deltas: str, steps: int = 10):
    """Byte offsets of the frames at so many equal steps, from the column of offset differences."""
    n = f"size({deltas})"
    return F.expr(f"if({n} = 0, cast(array() as array<bigint>), transform(sequence(0, {steps - 1}), k -> aggregate(slice({deltas}, 1, cast(k * {n} div {steps} as int) + 1), 0L, (t, x) -> t + x)))")


def op6(spark, sf_dir: str) -> DataFrame:
    p = probe_media(encode_media(documents(spark, sf_dir)))
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("n_frames", "n_bad_frames", "n_unchecked_frames", "skipped_bytes", "samples", "hertz", "vbr_frames")), F.concat(F.lit("seek="), F.array_join(seek_points("offset_deltas"), ",")))
    return p.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
