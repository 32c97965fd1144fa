"""Media columns: MPEG transport streams.

``multiplex`` stores a payload losslessly as the elementary stream of one programme: a PAT and a
PMT (with their CRC-32/MPEG-2), then one PES packet per access unit of ``UNIT`` bytes, with a
presentation time stamp, and a random-access mark with a clock reference on every
``RAP_EVERY``th unit. ``demultiplex`` parses a stream: it reads the programme tables, checks
continuity counters, reassembles the elementary packets and lists time stamps and
random-access points. Both work packet-parallel in numpy; memory is a small multiple of one
batch of texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x0000, 0x1000, 0x0100, 0x06, 0xBD
BLOCK, UNIT, RAP_EVERY, TICKS = 192, 192 * 48, 8, 3600
_COLS = np.arange(PACKET)


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(pid: int, table_id: int, ident: int, body: bytes) -> bytes:
    """A one-packet table section."""
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = _section(PAT_PID, 0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section(
    PMT_PID, 0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(pts: int) -> bytes:
    v = pts & 0x1FFFFFFFF
    return bytes([0x21 | (v >> 29) & 0x0E, (v >> 22) & 0xFF, 1 | (v >> 14) & 0xFE, (v >> 7) & 0xFF, 1 | (v << 1) & 0xFE])


def _clock(pts: int) -> bytes:
    base = pts & 0x1FFFFFFFF
    return ((base << 15) | 0x7E00).to_bytes(6, "big")


def multiplex(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload as a transport stream, one access unit per PES packet."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        piece = payload[at : at + unit]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(piece) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(k * TICKS) + piece
        field_ = b"\x07\x50" + _clock(k * TICKS) if k % RAP_EVERY == 0 else b""
        rest = PACKET - 4 - len(field_)
        full = max(0, (len(pes) - rest) // (PACKET - 4)) if len(pes) >= rest else 0
        first = min(len(pes), rest)
        tail = len(pes) - first - full * (PACKET - 4)
        n = 1 + full + (tail > 0)
        block = np.empty((n, PACKET), np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter += n
        data = np.frombuffer(pes, np.uint8)
        _fill(block[0], field_, data[:first])
        if full:
            block[1 : 1 + full, 4:] = data[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if tail:
            _fill(block[-1], b"", data[-tail:])
        out.append(block.tobytes())
    return b"".join(out)


def _fill(packet: np.ndarray, adaptation: bytes, data: np.ndarray) -> None:
    """One packet's payload behind its adaptation field, stuffed to the packet's size."""
    room = PACKET - 4 - len(data)
    if room:
        packet[3] |= 0x20
        body = adaptation or (b"\x00" if room > 1 else b"")
        packet[4] = room - 1
        packet[5 : 4 + room] = 0xFF
        if room > 1:
            packet[5 : 4 + max(len(body), 2)] = np.frombuffer(body[1:] if adaptation else b"\x00", np.uint8)
    packet[PACKET - len(data) :] = data


@dataclass
class Stream:
    """What a transport stream holds: its programme map, its elementary bytes, and faults by kind."""

    payload: bytes = b""
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    sync_errors: int = 0


def _sections(payloads: list[bytes], starts: list[bool]) -> Iterator[bytes | None]:
    """The sections of one PID's packets, over packet ends; None for one that is cut or whose CRC fails."""
    held, begun = b"", False
    for payload, start in zip(payloads, starts):
        if start:
            pointer = payload[0] + 1 if payload else 0
            if begun:
                held += payload[1:pointer]
                found, held = _whole(held)
                yield from found
                if held.strip(b"\xff"):
                    yield None
            held, begun = payload[pointer:], True
        elif begun:
            held += payload
        found, held = _whole(held)
        yield from found
        begun = begun and bool(held)
    if held.strip(b"\xff"):
        yield None


def _whole(held: bytes) -> tuple[list[bytes | None], bytes]:
    """The sections that are whole, without their CRC, and what follows; stuffing ends the packet."""
    out: list[bytes | None] = []
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) < size:
            return out, held
        section, held = held[:size], held[size:]
        out.append(section[:-4] if size > 12 and crc32_mpeg(section) == 0 else None)
    return out, b"" if held[:1] == b"\xff" else held


def _unrepeated(b: np.ndarray, offset: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, int]:
    """(packets that aren't a legal second copy of the one before; continuity errors of the others).

    A packet may come twice, with the same counter and payload; a counter may jump where the adaptation
    field says so; packets without payload don't count."""
    keep = np.ones(len(b), bool)
    at = np.flatnonzero(has)
    if len(at) < 2:
        return keep, 0
    counter = (b[at, 3] & 15).astype(np.int16)
    step = (counter[1:] - counter[:-1]) % 16
    flagged = (b[at, 3] & 0x20 != 0) & (b[at, 4] > 0) & (b[at, 5] & 0x80 != 0)
    same = (step == 0) & (offset[at[1:]] == offset[at[:-1]]) & ((b[at[1:]] == b[at[:-1]]) | (_COLS < offset[at[1:], None])).all(1)
    second = same & ~np.concatenate([[False], same[:-1]])
    keep[at[1:][second]] = False
    return keep, int(((step != 1) & ~second & ~flagged[1:]).sum())


def demultiplex(media: bytes) -> Stream:
    """Parses a stream; packets without the sync byte and a partial last packet count as sync errors."""
    out = Stream(packets=len(media) // PACKET)
    a = np.frombuffer(media, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    out.sync_errors = int(len(media) % PACKET > 0)
    if (bad := a[:, 0] != SYNC).any():
        out.sync_errors += int(bad.sum())
        a = a[~bad]
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    control, starts = a[:, 3] >> 4 & 3, a[:, 1] & 0x40 != 0
    offset = np.where(control & 2, 5 + a[:, 4].astype(np.int32), 4)
    offset = np.where(control & 1, np.minimum(offset, PACKET), PACKET)
    streams: dict[int, int] = {}

    def tables(own: int) -> Iterator[bytes]:
        at = np.flatnonzero((pid == own) & (offset < PACKET))
        for section in _sections([a[i, offset[i] :].tobytes() for i in at], starts[at].tolist()):
            if section is None:
                out.table_errors += 1
            else:
                yield section

    for section in tables(PAT_PID):
        for at in range(8, len(section) - 3, 4):
            program, pmt = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
            if program:
                out.programs.setdefault(program, {})
                streams[pmt] = program
    for own in streams:
        for section in tables(own):
            at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while at + 5 <= len(section):
                out.programs[streams[own]][int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)
    pieces = []
    for es in sorted({p for program in out.programs.values() for p in program}):
        mine = pid == es
        b, off, first, has = a[mine], offset[mine], starts[mine], control[mine] & 1 != 0
        keep, errors = _unrepeated(b, off, has)
        out.continuity_errors += errors
        if not keep.all():
            b, off, first = b[keep], off[keep], first[keep]
        flagged = (b[:, 3] & 0x20 != 0) & (b[:, 4] > 0) & (b[:, 5] & 0x40 != 0)
        sizes = PACKET - off
        data = b[_COLS[None, :] >= off[:, None]]
        at = np.concatenate([[0], np.cumsum(sizes)])
        begins = at[:-1][first]
        ends = np.append(begins[1:], len(data))
        kept = np.ones(len(data), bool)
        kept[: begins[0] if len(begins) else len(data)] = False
        for s, e in zip(begins, ends):
            head = data[s : s + 14].tobytes()
            if head[:3] != b"\x00\x00\x01" or len(head) < 9:
                out.sync_errors += 1
                kept[s:e] = False
                continue
            length, flags = int.from_bytes(head[4:6], "big"), head[7]
            kept[s : s + 9 + head[8]] = False
            if length:
                kept[s + 6 + length : e] = False
            if flags & 0x80:
                v = head[9:14]
                out.pts.append((v[0] >> 1 & 7) << 30 | v[1] << 22 | (v[2] >> 1) << 15 | v[3] << 7 | v[4] >> 1)
        unit_of = np.cumsum(first) - 1
        out.random_access += [int(x) for x in unit_of[flagged & first]]
        pieces.append(data[kept].tobytes())
    out.payload = b"".join(pieces)
    return out


def padded(text: bytes) -> bytes:
    """The text's bytes, then spaces up to a positive multiple of BLOCK."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text (null: empty) as a transport stream."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                texts = [x or b"" for x in rows.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([multiplex(padded(x)) for x in texts], pa.binary())], names=["key", "n_bytes", "media"]
                )

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary"
    return docs.select(key, F.col(text).cast("string")).mapInArrow(lambda b: (x.rename_columns([key, "n_bytes", "media"]) for x in stream(b)), schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parses every stored stream: its payload's digest, its tables, counts and faults as ``feature``, the
    time stamp of each access unit (``pts``) and which units are random-access points."""

    def row(stored: bytes) -> tuple:
        s = demultiplex(stored)
        programs = ";".join(f"{p}:" + ",".join(f"{k}/{t}" for k, t in sorted(es.items())) for p, es in sorted(s.programs.items()))
        last, rap = (s.pts[-1] if s.pts else -1), s.random_access
        marks = zlib.crc32(np.array(s.pts + rap, np.int64).tobytes())
        feature = f"programs={programs} packets={s.packets} units={len(s.pts)} last_pts={last} rap={len(rap)} marks={marks:08x} continuity={s.continuity_errors} tables={s.table_errors} sync={s.sync_errors}"
        return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, s.pts, rap

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = [key, "n_bytes", *(x.split()[0] for x in FEATURES.split(", "))]
        for batch in batches:
            if batch.num_rows:
                cols = zip(*(row(x.as_buffer().to_pybytes()) for x in batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, {FEATURES}"
    return media.select(key, "n_bytes", "media").mapInArrow(stream, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Every whole text stored as a transport stream and read back; one row per document.

    Null and empty texts store one block of spaces. Equal texts give equal values; null ids are
    carried, repeated rows stay rows, extra columns are not read; a very long text is one stream of many
    access units; an empty table gives none.
    """
    return read_back(store(docs))
