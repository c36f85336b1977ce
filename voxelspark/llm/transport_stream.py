"""Media columns: MPEG transport streams.

A payload is cut into packetised elementary stream (PES) packets of one media
unit each; every unit has a time stamp, every RANDOM_ACCESS-th unit starts with
a random-access flag and a clock reference. The stream has a program
association table and a program map table in front. The reader works on the
stored bytes only: it parses the tables, checks sync bytes, table checksums and
continuity counters, reassembles the packets of the elementary stream and
collects time stamps and random-access points.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, read

PACKET, UNIT, BLOCK = 188, 11_520, 576  # a unit is 20 blocks
PAT_PID, PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0, 0x100, 0x101, 1, 0x06
RANDOM_ACCESS, TICKS = 8, 3600  # units between random-access points; 90 kHz ticks of a unit


def _crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: not reflected, no final complement."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(pid: int, table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    data = head + body
    data += _crc32_mpeg(data).to_bytes(4, "big")
    packet = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + data
    return packet + b"\xff" * (PACKET - len(packet))


_TABLES = _section(PAT_PID, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section(PMT_PID, 2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(t: int) -> bytes:
    """33-bit presentation time in its five marked bytes."""
    return bytes([0x21 | (t >> 29 & 0x0E), t >> 22 & 0xFF, 0x01 | (t >> 14 & 0xFE), t >> 7 & 0xFF, 0x01 | (t << 1 & 0xFE)])


def mux(payload: bytes) -> bytes:
    """Transport stream of a payload."""
    out, counter = [_TABLES], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        piece = payload[at : at + UNIT]
        length = len(piece) + 8
        pes = np.frombuffer(b"\x00\x00\x01\xbd" + length.to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(unit * TICKS & 0x1FFFFFFFF) + piece, np.uint8)
        clock = unit % RANDOM_ACCESS == 0
        first = PACKET - 4 - (8 if clock else 0)
        count = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
        room = first + (count - 1) * (PACKET - 4)
        stuff = room - len(pes)  # all stuffing goes to the last packet
        p = np.zeros((count, PACKET), np.uint8)
        p[:, 0] = 0x47
        p[:, 1] = ES_PID >> 8
        p[0, 1] |= 0x40
        p[:, 2] = ES_PID & 0xFF
        p[:, 3] = 0x10 | ((counter + np.arange(count)) & 15)
        if clock:
            base = unit * TICKS & 0x1FFFFFFFF
            p[0, 3] |= 0x20
            p[0, 4:12] = list(bytes([7, 0x50]) + (base << 15 | 0x7E00).to_bytes(6, "big"))
        used = PACKET - first
        if count == 1:
            if stuff:
                size = (8 if clock else 0) + stuff
                p[0, 3] |= 0x20
                p[0, 4] = size - 1
                if not clock and size > 1:
                    p[0, 5] = 0
                p[0, (12 if clock else 6) : 4 + size] = 0xFF
            p[0, used + stuff :] = pes
        else:
            p[0, used:] = pes[:first]
            middle = (count - 2) * (PACKET - 4)
            p[1:-1, 4:] = pes[first : first + middle].reshape(-1, PACKET - 4)
            if stuff:
                p[-1, 3] |= 0x20
                p[-1, 4] = stuff - 1
                if stuff > 1:
                    p[-1, 5] = 0
                p[-1, 6 : 4 + stuff] = 0xFF
            p[-1, 4 + stuff :] = pes[first + middle :]
        counter = (counter + count) & 15
        out.append(p.tobytes())
    return b"".join(out)


def demux(data: bytes) -> tuple[bytes, dict]:
    """Payload of the first program's stream and what the reader found; raises ValueError on a broken stream."""
    p = np.frombuffer(data, np.uint8)
    if not len(p) or len(p) % PACKET:
        raise ValueError("not whole packets")
    p = p.reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("sync byte lost")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    section = _table(p, pid, PAT_PID)
    program, pmt = int.from_bytes(section[8:10], "big"), int.from_bytes(section[10:12], "big") & 0x1FFF
    section = _table(p, pid, pmt)
    skip = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
    kind, es = section[skip], int.from_bytes(section[skip + 1 : skip + 3], "big") & 0x1FFF
    q = p[pid == es]
    control = q[:, 3] >> 4 & 3
    counters = (q[:, 3] & 15).astype(np.int64)
    lost = int(((counters[1:] - counters[:-1]) % 16 != 1).sum())
    begin = np.where(control & 2, 5 + q[:, 4].astype(np.int64), 4)
    flags = np.where((control & 2 != 0) & (q[:, 4] > 0), q[:, 5], 0)
    starts = np.flatnonzero(q[:, 1] & 0x40)
    body = np.arange(PACKET)[None, :] >= begin[:, None]
    flat = q[body]
    ends = np.concatenate(([0], np.cumsum(PACKET - begin)))
    parts, stamps = [], []
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(q)).tolist()):
        pes = flat[ends[a] : ends[b]]
        head = pes[:14].tolist()
        if head[:3] != [0, 0, 1] or head[4] << 8 | head[5] != len(pes) - 6:
            raise ValueError("packet start lost")
        stamps.append((head[9] & 0x0E) << 29 | head[10] << 22 | (head[11] & 0xFE) << 14 | head[12] << 7 | head[13] >> 1)
        parts.append(pes[9 + head[8] :].tobytes())
    points = np.flatnonzero(np.isin(np.arange(len(q)), starts) & (flags & 0x40 != 0))
    return b"".join(parts), {"program": program, "pid": es, "stream_type": int(kind), "packets": len(p), "continuity_errors": lost, "pts": stamps, "random_access": [int(np.searchsorted(starts, x)) for x in points]}


def _table(p: np.ndarray, pid: np.ndarray, wanted: int) -> bytes:
    found = np.flatnonzero(pid == wanted)
    if not len(found):
        raise ValueError(f"no table with pid {wanted}")
    data = p[found[0]].tobytes()
    size = 3 + (int.from_bytes(data[6:8], "big") & 0x0FFF)
    section = data[5 : 5 + size]
    if _crc_of(section):
        raise ValueError("table checksum")
    return section


_checked: dict[bytes, int] = {}


def _crc_of(section: bytes) -> int:
    if section not in _checked:
        if len(_checked) > 1000:
            _checked.clear()
        _checked[section] = _crc32_mpeg(section)
    return _checked[section]


def to_payload(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of BLOCK."""
    return text + b"\xff" * ((-len(text)) % BLOCK or (0 if text else BLOCK))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            raw = [t.encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(to_payload(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, media (the transport stream of its padded UTF-8 text). Null texts count as empty."""
    return documents(docs).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload binary, packets long, continuity_errors long, pts array<long>, random_access array<long>, media binary"


def _decode(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                media = part.column("media").to_pylist()
                found = [demux(m) for m in media]
                info = [x[1] for x in found]
                if keep:
                    columns = [pa.array([x[0] for x in found], pa.binary()), pa.array([x["packets"] for x in info], pa.int64()), pa.array([x["continuity_errors"] for x in info], pa.int64()), pa.array([x["pts"] for x in info], pa.list_(pa.int64())), pa.array([x["random_access"] for x in info], pa.list_(pa.int64())), part.column("media")]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload", "packets", "continuity_errors", "pts", "random_access", "media"])
                    continue
                payload = [x[0] for x in found]
                columns = [pa.array([len(x) for x in payload], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payload]), pa.array([binascii.crc32(x[-32:]) for x in payload], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([_feature(x) for x in info])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return run


def _feature(x: dict) -> str:
    return f"program={x['program']};pid={x['pid']};type={x['stream_type']};packets={x['packets']};units={len(x['pts'])};pts={x['pts'][0]}-{x['pts'][-1]};random_access={len(x['random_access'])};continuity_errors={x['continuity_errors']}"


def decode_media(media: DataFrame) -> DataFrame:
    """Payload, time stamps and random-access points of each stream, read back from its bytes."""
    return media.mapInArrow(_decode(True), _READ)


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = encode_media(read(spark, sf_dir, "documents"))
    return media.mapInArrow(_decode(False), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
