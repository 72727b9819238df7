"""MPEG transport streams: a lossless carrier for payloads and a checking demultiplexer.

``mux`` cuts a payload into access units, puts groups of them into PES packets with
33-bit timestamps and those into 188-byte transport packets, with a program association
table and a program map table before each random-access point.  ``demux`` reads any stream
of one program that way: it parses both tables (with their CRC), checks continuity
counters, reassembles elementary packets and lists timestamps with random-access points.

Defined cases: a null text is the empty payload, which is one unit of padding; equal
payloads give equal streams; lost packets show as continuity errors and mark the elementary
packet they fall in as damaged, as does an elementary packet that is cut short; one without
a whole header is left out; a repeated packet is skipped; an empty table gives no rows; a very
long text is one stream in the memory of a task; columns other than id and text are not read,
so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import load, map_batches, texts

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x0100, 0x0101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
UNIT, UNITS_PER_PES, PES_PER_ACCESS, TICKS = 576, 8, 16, 3600


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    rest = ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    head = bytes([table_id]) + (0xB000 | len(rest) + 4).to_bytes(2, "big") + rest
    return head + section_crc(head).to_bytes(4, "big")


_PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 1 | (pts >> 14) & 0xFE, pts >> 7 & 0xFF, 1 | (pts << 1) & 0xFE])


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 up to a positive multiple of ``unit``."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\xff")


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream of a payload."""
    out: list[bytes] = []
    counter = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}
    heads = [bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10 | c]) for c in range(16)]

    def table(pid: int, section: bytes) -> None:
        out.append((bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter[pid]]) + b"\0" + section).ljust(PACKET, b"\xff"))
        counter[pid] = (counter[pid] + 1) & 15

    size = unit * UNITS_PER_PES
    for k, at in enumerate(range(0, len(payload), size)):
        pts = k * TICKS % (1 << 33)
        body = payload[at : at + size]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + body
        access = k % PES_PER_ACCESS == 0
        if access:
            table(PAT_PID, _PAT)
            table(PMT_PID, _PMT)
        field_ = bytes([7, 0x50]) + ((pts << 15) | 0x7E00).to_bytes(6, "big") if access else b""
        c, i, start = counter[DATA_PID], 0, 0x40
        while i < len(pes):
            if not field_ and not start and len(pes) - i >= 184:
                out.append(heads[c] + pes[i : i + 184])
                i += 184
            else:
                room = 184 - len(field_)
                if len(pes) - i < room:  # stuffing goes into the adaptation field
                    gap = room - (len(pes) - i)
                    if field_:
                        field_ = bytes([7 + gap]) + field_[1:] + b"\xff" * gap
                    else:
                        field_ = b"\0" if gap == 1 else bytes([gap - 1, 0]) + b"\xff" * (gap - 2)
                    room = len(pes) - i
                out.append(bytes([SYNC, start | DATA_PID >> 8, DATA_PID & 255, (0x30 if field_ else 0x10) | c]) + field_ + pes[i : i + room])
                i += room
                field_, start = b"", 0
            c = (c + 1) & 15
        counter[DATA_PID] = c
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number -> PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # elementary PID -> stream type
    payload: bytes = b""
    units: list[tuple[int | None, bool, int, int]] = field(default_factory=list)  # pts, random access, offset, size
    continuity_errors: int = 0
    table_errors: int = 0
    damaged: int = 0


def _sections(rows: np.ndarray, start: np.ndarray, unit_start: np.ndarray) -> list[bytes]:
    """Table sections of one PID, which may begin anywhere in a packet and go on in the next ones; one cut short is given as it is."""
    found: list[bytes] = []
    held: bytes | None = None

    def take(more: bytes) -> bytes | None:
        """Give whole sections and keep the rest."""
        while len(more) >= 3 and more[0] != 0xFF:
            n = 3 + ((more[1] & 0x0F) << 8 | more[2])
            if len(more) < n:
                return more
            found.append(more[:n])
            more = more[n:]
        return more if more and more[0] != 0xFF else None

    for row, at, first in zip(rows, start.tolist(), unit_start.tolist()):
        body = row[at:].tobytes()
        if not body:
            continue
        if first:
            pointer = body[0]
            if held is not None and (held := take(held + body[1 : 1 + pointer])) is not None:
                found.append(held)  # its end never came
            held = take(body[1 + pointer :])
        elif held is not None:
            held = take(held + body)
    if held is not None:
        found.append(held)
    return found


def demux(data: bytes) -> Stream:
    """Parse a stream; headers of all packets are read at once."""
    if len(data) % PACKET:
        raise ValueError("not a whole number of transport packets")
    a = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (a[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    out = Stream(packets=len(a))
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    first = (a[:, 1] & 0x40) > 0
    has_field, has_data, cc = (a[:, 3] & 0x20) > 0, (a[:, 3] & 0x10) > 0, a[:, 3] & 0x0F
    start = np.where(has_field, 5 + a[:, 4].astype(np.int32), 4)
    flags = np.where(has_field & (a[:, 4] > 0), a[:, 5], 0)

    for s in _sections(a[(at := np.flatnonzero(pid == PAT_PID))], start[at], first[at]):
        if len(s) < 12 or section_crc(s):
            out.table_errors += 1
            continue
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for pmt in sorted(set(out.programs.values())):
        for s in _sections(a[(at := np.flatnonzero(pid == pmt))], start[at], first[at]):
            if len(s) < 16 or section_crc(s):
                out.table_errors += 1
                continue
            i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
            while i + 5 <= len(s) - 4:
                out.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)

    parts: list[bytes] = []
    offset = 0
    for es in sorted(out.streams):
        at = np.flatnonzero((pid == es) & has_data)
        if not len(at):
            continue
        step = (cc[at][1:].astype(np.int32) - cc[at][:-1]) & 15
        told = (flags[at][1:] & 0x80) > 0
        again = np.concatenate(([False], (step == 0) & (a[at][1:] == a[at][:-1]).all(1)))
        lost = np.concatenate(([False], (step != 1) & ~told)) & ~again
        out.continuity_errors += int(lost.sum())
        at, lost = at[~again], lost[~again]
        rows, begin = a[at], start[at]
        mask = np.arange(PACKET)[None, :] >= begin[:, None]
        stream = rows[mask].tobytes()
        ends = np.concatenate(([0], np.cumsum(PACKET - np.minimum(begin, PACKET))))
        heads = np.flatnonzero(first[at])
        for h, n in zip(heads, [*heads[1:], len(at)]):
            pes = stream[ends[h] : ends[n]]
            whole = len(pes) >= 9 and pes[:3] == b"\0\0\1" and len(pes) >= 9 + pes[8]
            size = int.from_bytes(pes[4:6], "big") if whole else 0
            if not whole or lost[h + 1 : n].any() or len(pes) < 6 + size:
                out.damaged += 1
            if not whole:
                continue
            body = pes[9 + pes[8] : 6 + size if size else None]
            pts = None
            if pes[7] & 0x80 and pes[8] >= 5:
                p = pes[9:14]
                pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
            out.units.append((pts, bool(flags[at[h]] & 0x40), offset, len(body)))
            parts.append(body)
            offset += len(body)
    out.payload = b"".join(parts)
    return out


def feature(s: Stream) -> str:
    """A one-line summary of a stream's tables, packets and timestamps."""
    times = [t for t, *_ in s.units if t is not None]
    tables = ",".join(f"{n}:{p}" for n, p in sorted(s.programs.items()))
    kinds = ",".join(f"{p}:{t}" for p, t in sorted(s.streams.items()))
    span = (times[0], times[-1]) if times else ("", "")
    return (
        f"programs={tables};streams={kinds};packets={s.packets};pes={len(s.units)};random_access={sum(r for _, r, *_ in s.units)};"
        f"first_pts={span[0]};last_pts={span[1]};continuity_errors={s.continuity_errors};damaged={s.damaged};table_errors={s.table_errors}"
    )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: the stored stream, its digests and its elementary packets (timestamp, random access, place).

    All features are computed from the bytes read back out of the stream.  One narrow pass.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def columns(batch: pa.RecordBatch) -> dict:
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units", "media")
        out: dict = {"id": batch.column(0), **{n: [] for n in names}}
        for text in texts(batch):
            raw = (text or "").encode("utf-8", "replace")
            media = mux(pad(raw))
            back = demux(media)
            values = (len(raw), len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back))
            units = [{"pts": p, "random_access": r, "offset": o, "size": n} for p, r, o, n in back.units]
            for n, v in zip(names, (*values, units, media)):
                out[n].append(v)
        return out

    schema = (
        f"id {own.schema['id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, feature string, units array<struct<pts:bigint,random_access:boolean,offset:bigint,size:bigint>>, media binary"
    )
    return map_batches(own, schema, columns).withColumnRenamed("id", id_col)


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, then the elementary packets and the stream itself."""
    return media_columns(load(spark, sf_dir, "documents"))
