"""MPEG transport streams as media columns: writing, and checked reading.

Fixed values of the format (ISO/IEC 13818-1): 188-byte packets with sync byte
0x47, PAT on PID 0, sections with CRC-32/MPEG-2, a 33-bit clock of 90 kHz.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC, CLOCK = 188, 0x47, 1 << 33
PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD
#: Payload bytes of one access unit, units between tables and random-access points, clock ticks a unit.
UNIT, KEY_EVERY, TICKS = 16_384, 8, 3_600


@lru_cache(maxsize=4096)
def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=64)
def table_packet(pid: int, counter: int, body: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter])
    return (head + b"\0" + body).ljust(PACKET, b"\xff")


PAT = section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")


def clock_bytes(ticks: int, mark: int) -> bytes:
    t = ticks % CLOCK
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def mux(payload: bytes) -> bytes:
    """One program with one private stream that carries ``payload`` in timed units."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, key, pts = payload[at : at + UNIT], k % KEY_EVERY == 0, k * TICKS
        if key:
            out += [table_packet(0, tables % 16, PAT), table_packet(PMT_PID, tables % 16, PMT)]
            tables += 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + clock_bytes(pts, 2) + unit
        pcr = bytes([pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF, (pts & 1) << 7 | 0x7E, 0])
        field_ = bytes([0x50 if key else 0x10]) + pcr
        first = min(len(pes), PACKET - 4 - 8)
        count = 1 + -(-(len(pes) - first) // 184)
        grid = np.full((count, PACKET), 0xFF, np.uint8)
        grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        grid[0, 1] |= 0x40
        grid[:, 3] = 0x10 | (counter + np.arange(count)) % 16
        counter += count
        room = 184 - first  # the field's length byte, flags, clock, stuffing
        grid[0, 3] |= 0x20
        grid[0, 4] = room - 1
        grid[0, 5:12] = np.frombuffer(field_, np.uint8)
        grid[0, PACKET - first :] = np.frombuffer(pes[:first], np.uint8)
        rest = np.frombuffer(pes[first:], np.uint8)
        whole = len(rest) // 184
        if whole:
            grid[1 : whole + 1, 4:] = rest[: whole * 184].reshape(whole, 184)
        if tail := len(rest) - whole * 184:
            spare = 184 - tail
            grid[-1, 3] |= 0x20
            grid[-1, 4] = spare - 1
            if spare > 1:
                grid[-1, 5] = 0
            grid[-1, PACKET - tail :] = rest[whole * 184 :]
        out.append(grid.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    pid: int
    kind: int
    units: list[bytes] = field(default_factory=list)
    times: list[int | None] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)  # units at which decoding can begin


@dataclass
class Parsed:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Stream] = field(default_factory=dict)
    packets: int = 0
    skipped_bytes: int = 0
    gaps: int = 0
    duplicates: int = 0
    table_errors: int = 0
    unit_errors: int = 0
    damaged: int = 0


def aligned(data: bytes) -> tuple[np.ndarray, int]:
    """Packets by rows, and the bytes skipped to find and regain the sync byte."""
    buf, at, parts, skipped = np.frombuffer(data, np.uint8), 0, [], 0
    while len(buf) - at >= PACKET:
        n = (len(buf) - at) // PACKET
        good = buf[at : at + n * PACKET : PACKET] == SYNC
        run = n if good.all() else int(np.argmin(good))
        if run:
            parts.append(buf[at : at + run * PACKET].reshape(run, PACKET))
            at += run * PACKET
            continue
        marks = np.flatnonzero(buf[at + 1 :] == SYNC) + at + 1
        marks = marks[(marks + PACKET >= len(buf)) | (buf[np.minimum(marks + PACKET, len(buf) - 1)] == SYNC)]
        new = int(marks[0]) if len(marks) else len(buf)
        skipped += new - at
        at = new
    return (np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8)), skipped + len(buf) - at


def read_section(data: bytes, table_id: int) -> bytes | None:
    """The body of one whole section of that table; None where it is another or its checksum is wrong."""
    if len(data) < 12 or data[0] != table_id or crc_mpeg(data[:-4]) != int.from_bytes(data[-4:], "big"):
        return None
    return data[3:-4]


def sections_of(parts: list[tuple[bool, bytes]]) -> Iterator[bytes | None]:
    """Sections of one PID's payloads ``(starts a section, bytes)``: several in a packet,
    or one over several packets. None for each that breaks off."""
    held = b""
    for start, data in parts:
        if start:
            begin = 1 + data[0] if data else 0
            if held:
                held += data[1:begin]
                held = yield from whole(held)
                if held:
                    yield None
            held = data[begin:]
        elif held:
            held += data
        held = yield from whole(held)
    if held:
        yield None


def whole(held: bytes) -> Iterator[bytes]:
    """The complete sections at the start of ``held``; returns the rest, without stuffing."""
    while len(held) >= 3 and held[0] != 0xFF:
        end = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) < end:
            return held
        yield held[:end]
        held = held[end:]
    return b"" if held[:1] == b"\xff" else held


def read_clock(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(data: bytes | None) -> Parsed:
    """Parse a stream: tables, continuity, packetised units, clock, random-access points.

    Damage is counted, never raised: lost sync, packets flagged by the transport
    (these are not used), counter gaps (a repeated packet is dropped as a duplicate;
    a flagged discontinuity is no gap), bad table checksums, bad units. Sections may
    span packets. Null and empty data give an empty result.
    """
    out = Parsed()
    packets, out.skipped_bytes = aligned(data or b"")
    out.packets = len(packets)
    sound = packets[:, 1] & 0x80 == 0
    if not sound.all():
        out.damaged = int((~sound).sum())
        packets = packets[sound]
    pids = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    start, control = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3
    begin = np.where(control & 2 > 0, 5 + packets[:, 4].astype(np.int64), 4)
    begin = np.where(control & 1 > 0, np.minimum(begin, PACKET), PACKET)

    def tables(pid: int, table_id: int) -> Iterator[bytes]:
        own = np.flatnonzero((pids == pid) & (begin < PACKET))
        for data in sections_of([(bool(start[k]), packets[k, begin[k] :].tobytes()) for k in own.tolist()]):
            got = None if data is None else read_section(data, table_id)
            if got is None:
                out.table_errors += 1
            else:
                yield got

    for body in tables(0, 0):
        for k in range(5, len(body) - 3, 4):
            if number := int.from_bytes(body[k : k + 2], "big"):
                out.programs[number] = int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
    for pid in sorted(set(out.programs.values())):
        for body in tables(pid, 2):
            k = 9 + (int.from_bytes(body[7:9], "big") & 0xFFF)
            while k + 5 <= len(body):
                es = int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF
                out.streams.setdefault(es, Stream(es, body[k]))
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0xFFF)
    for pid, stream in out.streams.items():
        own = np.flatnonzero((pids == pid) & (control & 1 > 0))
        counters = packets[own, 3] & 15
        step = (np.diff(counters.astype(np.int64))) % 16
        same = np.append(False, (step == 0) & (packets[own[1:], 4:] == packets[own[:-1], 4:]).all(axis=1)) if len(own) else np.zeros(0, bool)
        out.duplicates += int(same.sum())
        told = (control[own] & 2 > 0) & (packets[own, 4] > 0) & (packets[own, 5] & 0x80 > 0)
        out.gaps += int(((step != 1) & ~same[1:] & ~told[1:]).sum()) if len(own) else 0
        own = own[~same]
        heads = np.flatnonzero(start[own])
        inside = np.arange(PACKET)[None, :] >= begin[own][:, None]
        body, sizes = packets[own][inside].tobytes(), np.append(0, np.cumsum(PACKET - begin[own]))
        for h, nxt in zip(heads, np.append(heads[1:], len(own))):
            pes, k = body[sizes[h] : sizes[nxt]], own[h]
            size = int.from_bytes(pes[4:6], "big") if len(pes) >= 9 else 0
            if len(pes) < 9 or pes[:3] != b"\0\0\1" or size and len(pes) < 6 + size:
                out.unit_errors += 1
                continue
            if control[k] & 2 and packets[k, 4] and packets[k, 5] & 0x40:
                stream.keys.append(len(stream.units))
            stream.times.append(read_clock(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None)
            stream.units.append(pes[9 + pes[8] : 6 + size if size else None])
    return out


def unwrapped(times: list[int | None]) -> list[int | None]:
    """Time stamps in order of arrival, continued across the 33-bit wrap; missing ones stay missing."""
    out: list[int | None] = []
    last = None
    for t in times:
        if t is not None:
            last = t if last is None else last + (t - last + CLOCK // 2) % CLOCK - CLOCK // 2
        out.append(None if t is None else last)
    return out


def text_payload(text: str | None, multiple: int = 64) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % multiple or (multiple if not raw else 0))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, media)``: each text as a transport stream; null is empty.

    The payload is padded with zero bytes to a positive multiple of 64. Equal texts
    give equal streams; repeated rows, null ids and very long texts are rows like any
    other, an empty table gives an empty one, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(text_payload(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, streams int, units long, random_access array<struct<unit:bigint,pts:bigint>>, first_pts long, last_pts long, gaps long, duplicates long, errors long, feature string"

READ_NAMES = [x.split()[0] for x in READ.replace("unit:bigint,pts", "").split(", ")]


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Parse stored streams: digests of the first stream's bytes, timing, damage.

    ``random_access``: the units at which decoding can begin, each with its time
    stamp (continued across the 33-bit wrap; null where it carries none). Extra column
    kept: ``n_bytes`` where present. Null media read as empty; rows repeat as they do
    in ``df``. A very long stream is read whole: memory is a few times its bytes.
    """
    extra = [c for c in ("n_bytes",) if c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(x.as_py()) for x in batch.column(1)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(k + 2) for k in range(len(extra))], *cols], names=names)

    def digest(media: bytes | None) -> tuple:
        got = demux(media)
        stream = next(iter(got.streams.values()), Stream(0, 0))
        payload, stamps = b"".join(stream.units), unwrapped(stream.times)
        times = [t for t in stamps if t is not None]
        errors = got.table_errors + got.unit_errors + got.damaged + (got.skipped_bytes > 0)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        share = counts[counts > 0] / max(1, len(payload))
        entropy = float(-(share * np.log2(share)).sum())
        span = times[-1] - times[0] if times else 0
        feature = f"programs={len(got.programs)};streams={len(got.streams)};packets={got.packets};units={len(stream.units)};keys={len(stream.keys)};span={span};gaps={got.gaps};errors={errors};entropy={entropy:.4f}"
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), got.packets, len(got.streams), len(stream.units), [{"unit": k, "pts": stamps[k]} for k in stream.keys], times[0] if times else None, times[-1] if times else None, got.gaps, got.duplicates, errors, feature)

    i, s = pa.int64(), pa.string()
    kinds = [i, s, i, i, s, i, pa.int32(), i, pa.list_(pa.struct([("unit", i), ("pts", i)])), i, i, i, i, i, s]
    names = ["id", *extra, *(x.split()[0] for x in READ_NAMES)]
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), *extra).mapInArrow(run, f"id {kind}, " + "".join(f"{c} long, " for c in extra) + READ)
    return out.withColumnRenamed("id", id_col)
