"""Media columns: bytes in MPEG transport streams (ISO/IEC 13818-1), written and read back with numpy.

A stream holds one program with one elementary stream of private data. Every access unit is one PES packet with a
presentation time stamp; its first transport packet carries the clock reference and, on every RAP_EVERY-th unit, the
random-access flag. The reader parses PAT and PMT (with their CRC), checks sync bytes and continuity counters, and
reassembles the elementary packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import slices

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
UNIT_BYTES, RAP_EVERY, TABLES_EVERY, PTS_STEP = 32768, 4, 16, 3600

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
UNIT_TYPE = "array<struct<pts:long,start:long,length:long,random_access:boolean>>"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def psi_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + psi_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = np.full(PACKET, 0xFF, dtype=np.uint8)
    packet[:5] = [SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]
    packet[5 : 5 + len(section)] = np.frombuffer(section, dtype=np.uint8)
    return packet


_PAT = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, 6, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 255, (pts >> 14) & 0xFE | 1, (pts >> 7) & 255, (pts << 1) & 0xFE | 1])


def _clock(pts: int) -> bytes:
    return bytes([(pts >> 25) & 255, (pts >> 17) & 255, (pts >> 9) & 255, (pts >> 1) & 255, (pts & 1) << 7 | 0x7E, 0])


def _unit_packets(unit: bytes, number: int, counter: int) -> np.ndarray:
    pts = number * PTS_STEP & (1 << 33) - 1
    pes = np.frombuffer(b"\0\0\1\xbd" + (len(unit) + 8 & 0xFFFF).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit, dtype=np.uint8)
    first = BODY - 8
    rest = len(pes) - first
    n = 1 + max(0, -(-rest // BODY))
    out = np.empty((n, PACKET), dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 3] |= 0x20
    stuffing = max(0, -rest)
    out[0, 4:12] = np.frombuffer(bytes([7 + stuffing, 0x10 | (number % RAP_EVERY == 0) << 6]) + _clock(pts), dtype=np.uint8)
    out[0, 12 : 12 + stuffing] = 0xFF
    out[0, 12 + stuffing :] = pes[: first - stuffing]
    if n > 1:
        whole = rest // BODY
        out[1 : 1 + whole, 4:] = pes[first : first + whole * BODY].reshape(-1, BODY)
        if tail := rest - whole * BODY:
            gap = BODY - tail
            out[-1, 3] |= 0x20
            out[-1, 4] = gap - 1
            out[-1, 5 : 4 + gap] = 0xFF
            if gap > 1:
                out[-1, 5] = 0
            out[-1, 4 + gap :] = pes[first + whole * BODY :]
    return out


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """A transport stream of the payload; the tables come first and again before every TABLES_EVERY-th unit."""
    if not 0 < unit_bytes <= 65000:
        raise ValueError("a unit must fit a PES packet")
    parts, counter = [], 0
    for number, at in enumerate(range(0, max(1, len(payload)), unit_bytes)):
        if number % TABLES_EVERY == 0:
            for table in (_PAT, _PMT):
                table = table.copy()
                table[3] |= number // TABLES_EVERY & 15
                parts.append(table.tobytes())
        packets = _unit_packets(payload[at : at + unit_bytes], number, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


def _read_section(packet: np.ndarray, table: int) -> bytes:
    body = packet[5 + int(packet[4]) :].tobytes()
    section = body[: 3 + ((body[1] & 15) << 8 | body[2])]
    if section[0] != table or psi_crc(section) != 0:
        raise ValueError("damaged program table")
    return section[8:-4]


def demux(media: bytes) -> tuple[bytes, list[dict], dict]:
    """(payload, units, counts). Raises on lost sync or damaged tables; continuity errors are counted, not hidden."""
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    if not len(packets) or (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = np.flatnonzero(pid == PAT_PID)
    if not len(pat):
        raise ValueError("no program table")
    programs = _read_section(packets[pat[0]], 0)
    pmt_pid = (programs[2] & 0x1F) << 8 | programs[3]
    pmt = np.flatnonzero(pid == pmt_pid)
    if not len(pmt):
        raise ValueError("no program map")
    streams = _read_section(packets[pmt[0]], 2)
    skip = 4 + ((streams[2] & 15) << 8 | streams[3])
    data_pid = (streams[skip + 1] & 0x1F) << 8 | streams[skip + 2]
    errors = 0
    for one in (PAT_PID, pmt_pid, data_pid):
        counters = packets[pid == one, 3] & 15
        errors += int(((counters[1:] - counters[:-1]) & 15 != 1).sum())
    own = packets[pid == data_pid]
    adapted = own[:, 3] & 0x20 != 0
    start = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    held = own[np.arange(PACKET) >= start[:, None]].tobytes()
    lengths = PACKET - start
    ends = np.cumsum(lengths)
    begins = np.flatnonzero(own[:, 1] & 0x40)
    edges = [*(ends[begins] - lengths[begins]).tolist(), len(held)]
    parts, units, at = [], [], 0
    for k, b in enumerate(begins):
        pes = held[edges[k] : edges[k + 1]]
        if pes[:3] != b"\0\0\1":
            raise ValueError("damaged elementary packet")
        size = int.from_bytes(pes[4:6], "big") + 6
        s = pes[9:14]
        pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
        part = pes[9 + pes[8] : size]
        units.append({"pts": pts, "start": at, "length": len(part), "random_access": bool(adapted[b] and own[b, 4] and own[b, 5] & 0x40)})
        parts.append(part)
        at += len(part)
    return b"".join(parts), units, {"packets": len(packets), "continuity_errors": errors}


def padded(data: bytes, to: int = 64) -> bytes:
    return data + bytes(max(to, -(-len(data) // to) * to) - len(data))


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's padded UTF-8 bytes as a transport stream. A null text is empty; rows are never merged."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(put, MEDIA_SCHEMA)


def read_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (as stored, with padding), units and continuity counts, from the stored bytes alone."""
    schema = f"doc_id long, n_bytes long, media binary, payload binary, packets long, continuity_errors long, units {UNIT_TYPE}"
    kind = pa.list_(pa.struct([("pts", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_())]))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            found = [demux(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([x[0] for x in found], pa.binary()), pa.array([x[2]["packets"] for x in found], pa.int64()), pa.array([x[2]["continuity_errors"] for x in found], pa.int64()), pa.array([x[1] for x in found], kind)],
                ["doc_id", "n_bytes", "media", "payload", "packets", "continuity_errors", "units"],
            )

    return stored.mapInArrow(get, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of read_media(store_media(docs)): hashes of the stored form and of what is read back from it.

    Defined cases: a null text is empty, and an empty text is stored as 64 bytes 0; a null doc_id stays null; equal texts give
    equal values, and repeated rows a row each; no rows give none; other columns are not read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_random_access long, continuity_errors long"

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows = []
            for doc_id, n, media in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                payload, units, counts = demux(media)
                raps = sum(u["random_access"] for u in units)
                mean = int(np.frombuffer(payload, dtype=np.uint8).sum()) // len(payload)
                feature = f"ts:packets={counts['packets']};units={len(units)};rap={raps};pts={units[0]['pts']}-{units[-1]['pts']};cc_errors={counts['continuity_errors']};mean={mean}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(units), raps, counts["continuity_errors"]))
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return store_media(docs).mapInArrow(get, schema)
