"""Media columns: MPEG transport streams.

``mux`` stores a payload in a program stream of one private elementary stream: program tables (PAT, PMT) before each
random-access unit, one packetised elementary packet (PES) with a time stamp per access unit, 188-byte packets with
continuity counters. ``demux`` reads any column of such streams: it parses the program tables, checks the counters,
reassembles elementary packets and gives their time stamps and random-access points. Both work on one row at a time in
Arrow batches, so no row meets another and a task's memory is bounded by its batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import id_and_text, read_table, utf8

PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, PMT_PID, STREAM_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
#: Payload bytes of an access unit (a PES packet's length has 16 bits), ticks of 90 kHz between units, units from one random-access point to the next.
UNIT_BYTES, UNIT_TICKS, GROUP_UNITS = 32_768, 3_600, 4
#: Payloads are padded with zero bytes to a positive multiple of this.
BLOCK = 64

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
UNIT_SCHEMA = "doc_id long, pid int, stream_type int, unit int, pts long, dts long, random_access boolean, damaged boolean, payload binary"


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: most significant bit first, no final inversion; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ byte]
    return c


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 4)).to_bytes(2, "big") + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_body(section: bytes) -> bytes:
    return (b"\x00" + section).ljust(BODY, b"\xff")


#: Stream id 1, version 0, current, section 0 of 0; then the program's PMT, and its PCR and one stream.
_PAT = _table_body(_section(0x00, b"\x00\x01\xc1\x00\x00" + b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_body(_section(0x02, b"\x00\x01\xc1\x00\x00" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(mark: int, ticks: int) -> bytes:
    """A 33-bit time stamp in five bytes with marker bits."""
    return bytes([mark << 4 | (ticks >> 29 & 0x0E) | 1]) + ((ticks >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((ticks << 1 & 0xFFFE) | 1).to_bytes(2, "big")


def _ticks(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | (int.from_bytes(b[1:3], "big") & 0xFFFE) << 14 | int.from_bytes(b[3:5], "big") >> 1


def _head(pid: int, start: bool, adaptation: bool, payload: bool, counter: int) -> bytes:
    return bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x20 if adaptation else 0) | (0x10 if payload else 0) | counter])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries payload; an empty one gives one empty unit."""
    out, counter, tables = [], 0, 0
    middle = [_head(STREAM_PID, False, False, True, c) for c in range(16)]
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        ticks, access = unit * UNIT_TICKS & 0x1FFFFFFFF, unit % GROUP_UNITS == 0
        if access:
            out += [_head(PAT_PID, True, False, True, tables), _PAT, _head(PMT_PID, True, False, True, tables), _PMT]
            tables = (tables + 1) & 15
        data = payload[at : at + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + data
        # The clock reference: 33 bits at 90 kHz, six reserved bits, nine bits at 27 MHz.
        field_ = b"\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big") if access else b""
        pos, start = 0, True
        while pos < len(pes):
            room = BODY - (len(field_) + 1 if field_ else 0)
            left = len(pes) - pos
            if left < room:  # stuffing fills the packet
                gap = room - left
                if not field_:
                    field_ = b"" if gap == 1 else b"\x00" + b"\xff" * (gap - 2)
                else:
                    field_ += b"\xff" * gap
                out += [_head(STREAM_PID, start, True, True, counter), bytes([len(field_)]), field_, pes[pos:]]
                pos = len(pes)
            elif field_:
                out += [_head(STREAM_PID, start, True, True, counter), bytes([len(field_)]), field_, pes[pos : pos + room]]
                pos += room
            else:
                out += [_head(STREAM_PID, True, False, True, counter) if start else middle[counter], pes[pos : pos + BODY]]
                pos += BODY
            counter, start, field_ = (counter + 1) & 15, False, b""
    return b"".join(out)


@dataclass
class Unit:
    pid: int
    stream_type: int
    pts: int | None
    dts: int | None
    random_access: bool
    damaged: bool
    payload: bytes


@dataclass
class Stream:
    """What demux has found: whole tables, counters and units in the order of their last packets."""

    packets: int = 0
    lost_sync: int = 0
    counter_errors: int = 0
    duplicates: int = 0
    bad_tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)


def _sections(data: bytes) -> Iterator[bytes]:
    """Whole sections after a pointer field."""
    at = 1 + data[0] if data else 0
    while at + 3 <= len(data) and data[at] != 0xFF:
        end = at + 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0x0FFF)
        if end > len(data):
            return
        yield data[at:end]
        at = end


def _unit(pid: int, kind: int, data: bytes, access: bool, damaged: bool) -> Unit | None:
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None
    size, flags, head = int.from_bytes(data[4:6], "big"), data[7] >> 6, data[8]
    pts = _ticks(data[9:14]) if flags & 2 and len(data) >= 14 else None
    dts = _ticks(data[14:19]) if flags == 3 and len(data) >= 19 else pts
    end = 6 + size if size else len(data)
    return Unit(pid, kind, pts, dts, access, damaged or end > len(data), data[9 + head : end])


def demux(media: bytes) -> Stream:
    """Parses a stream. Lost packets mark the unit that they fall in as damaged; a repeated packet counts once; bytes
    that belong to no packet are passed over until sync bytes stand 188 apart; tables with a wrong CRC are not used."""
    out, last, open_ = Stream(), {}, {}
    at, size = 0, len(media)

    def close(pid: int) -> None:
        parts, access, damaged = open_.pop(pid)
        if unit := _unit(pid, out.types[pid], b"".join(parts), access, damaged):
            out.units.append(unit)

    while at + PACKET <= size:
        if media[at] != SYNC or (at + PACKET < size and media[at + PACKET] != SYNC and at + 2 * PACKET <= size):
            out.lost_sync += 1
            at = media.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        word = int.from_bytes(media[at : at + 4], "big")
        pid, counter = word >> 8 & 0x1FFF, word & 15
        out.packets += 1
        begin, end, at = at + 4, at + PACKET, at + PACKET
        if word >> 23 & 1 or pid == NULL_PID:  # marked as broken, or stuffing
            continue
        access = jump = False
        if word & 0x20:
            length = media[begin]
            if length:
                jump, access = bool(media[begin + 1] & 0x80), bool(media[begin + 1] & 0x40)
            begin += 1 + length
        if not word & 0x10 or begin > end:
            continue
        was = last.get(pid)
        if was is not None and not jump:
            if counter == was[0] and media[begin:end] == was[1]:
                out.duplicates += 1
                continue
            if counter != (was[0] + 1) & 15:
                out.counter_errors += 1
                if pid in open_:
                    open_[pid][2] = True
        body = media[begin:end]
        last[pid] = (counter, body)
        start = bool(word & 0x400000)
        if pid == PAT_PID or pid in out.programs.values():
            for section in _sections(body) if start else ():
                if section_crc(section):
                    out.bad_tables += 1
                elif section[0] == 0x00:
                    out.programs |= {int.from_bytes(section[i : i + 2], "big"): int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(section) - 4, 4) if section[i : i + 2] != b"\x00\x00"}
                elif section[0] == 0x02:
                    i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                    while i + 5 <= len(section) - 4:
                        out.types[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                        i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)
        elif pid in out.types:
            if start:
                if pid in open_:
                    close(pid)
                open_[pid] = [[body], access, False]
            elif pid in open_:
                open_[pid][0].append(body)
    for pid in list(open_):
        close(pid)
    return out


def feature(stream: Stream) -> str:
    """The stream's structure in one line."""
    stamps = [u.pts for u in stream.units if u.pts is not None]
    points = [u.pts for u in stream.units if u.random_access]
    kinds = ";".join(f"{pid}:{kind}" for pid, kind in sorted(stream.types.items()))
    return f"packets={stream.packets},programs={len(stream.programs)},streams={kinds},units={len(stream.units)},first_pts={min(stamps, default='')},last_pts={max(stamps, default='')},access={';'.join(map(str, points))},counter_errors={stream.counter_errors},duplicates={stream.duplicates},damaged={sum(u.damaged for u in stream.units)}"


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\x00")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), media: each text, padded, as a transport stream.

    Null and empty texts give one block of zeros; rows without an id and repeated rows are kept; an empty table gives an
    empty result; other columns are ignored, whatever their names. Equal texts give equal media.
    """

    def run(batches):
        for batch in batches:
            data = [utf8(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array([mux(pad(d)) for d in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back: payload, its digests, the stored form's digest, and the stream's structure.

    Takes the columns of ``store_texts``; null media count as an empty stream (payload of 0 bytes, no packets).
    """

    def run(batches):
        for batch in batches:
            rows = []
            for stored in batch.column(2).to_pylist():
                stored = stored or b""
                stream = demux(stored)
                payload = b"".join(u.payload for u in stream.units)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stream)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURE_SCHEMA)


def media_units(media: DataFrame) -> DataFrame:
    """One row per access unit of each stream: its stamps, random-access flag, damage and payload."""

    def run(batches):
        for batch in batches:
            for doc_id, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = demux(stored or b"").units
                if units:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(units), pa.int64()), "pid": pa.array([u.pid for u in units], pa.int32()), "stream_type": pa.array([u.stream_type for u in units], pa.int32()), "unit": pa.array(range(len(units)), pa.int32()), "pts": pa.array([u.pts for u in units], pa.int64()), "dts": pa.array([u.dts for u in units], pa.int64()), "random_access": pa.array([u.random_access for u in units], pa.bool_()), "damaged": pa.array([u.damaged for u in units], pa.bool_()), "payload": pa.array([u.payload for u in units], pa.binary())})

    return media.select("doc_id", "media").mapInArrow(run, UNIT_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(read_table(spark, sf_dir, "documents")))
