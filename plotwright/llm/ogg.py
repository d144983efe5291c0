"""Media columns as Ogg: pages with checksums, lacing, logical streams and granule positions.

A stored text is one physical Ogg file with two logical streams. The audio stream carries the payload as
unsigned 8-bit mono samples in packets of FRAME samples; its granule position counts samples. The comment
stream has one packet with the number of payload bytes that are text. Each stream begins with an
identification packet on a page of its own (the beginning-of-stream flag) and ends with the end-of-stream flag.

Page header (little endian): ``OggS``, version 0, flags (1 continued, 2 first, 4 last), granule position
int64, serial uint32, sequence uint32, checksum uint32, number of segments, the segments' sizes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, slices, table

FRAME = 576
RATE = 8000
AUDIO, COMMENT = 1, 2
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sBIBI")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes aren't a sound Ogg file."""


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (0x04C11DB7, not reflected, from 0): zlib's over mirrored bytes, mirrored back."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _lacing(size: int) -> bytes:
    """Sizes of the segments of a packet; a size under 255 ends it."""
    return b"\xff" * (size // 255) + bytes((size % 255,))


def pages_of(packets: list[tuple[bytes, int]], serial: int, sequence: int = 0) -> list[bytes]:
    """Pages for (packet, granule position at its end). A page without a packet's end has granule position -1."""
    lacing, body, ends, ats = bytearray(), bytearray(), [], []
    for packet, granule in packets:
        lacing += _lacing(len(packet))
        body += packet
        ends.append(len(lacing))
        ats.append(granule)
    out, at, byte, done = [], 0, 0, 0
    while at < len(lacing):
        part = bytes(lacing[at : at + 255])
        flags = CONTINUED * (at > 0 and lacing[at - 1] == 255) | LAST * (at + len(part) == len(lacing))
        granule = -1
        while done < len(ends) and ends[done] <= at + len(part):
            granule = ats[done]
            done += 1
        size = sum(part)
        out.append(_page(flags, granule, serial, sequence + len(out), part, bytes(body[byte : byte + size])))
        at += len(part)
        byte += size
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """One Ogg file for a payload of a positive multiple of FRAME bytes."""
    firsts = []
    for serial, name in ((AUDIO, b"PCM8MONO"), (COMMENT, b"PW8NOTES")):
        ident = _IDENT.pack(name, 1, RATE, 8, FRAME)
        firsts.append(_page(FIRST, 0, serial, 0, _lacing(len(ident)), ident))
    audio = pages_of([(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)], AUDIO, 1)
    notes = pages_of([(struct.pack("<Q", n_bytes), 0)], COMMENT, 1)
    return b"".join([*firsts, audio[0], *notes, *audio[1:]])  # the streams' pages are mixed


def decode(media: bytes) -> dict[int, dict]:
    """The logical streams by serial: packets, granule positions of the pages, rate; raises OggError."""
    streams: dict[int, dict] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if at + _HEADER.size > len(media):
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, sequence, crc, segments = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one is expected")
        start = at + _HEADER.size + segments
        lacing = media[at + _HEADER.size : start]
        end = start + sum(lacing)
        if len(lacing) < segments or end > len(media):
            raise OggError("a page is cut off")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError("a page's checksum is wrong")
        if flags & FIRST:
            if serial in streams or sequence:
                raise OggError("a stream begins twice")
            streams[serial] = {"packets": [], "granules": [], "next": 0, "open": None, "ended": False}
        s = streams.get(serial)
        if s is None or s["ended"] or s["next"] != sequence:
            raise OggError("a page is missing or out of order")
        if bool(flags & CONTINUED) != (s["open"] is not None):
            raise OggError("a packet's parts don't fit")
        s["next"] += 1
        parts = s["open"] or []
        s["open"] = None
        byte = size = 0
        for n in lacing:
            size += n
            if n < 255:
                parts.append(view[start + byte : start + byte + size])
                s["packets"].append(parts[0] if len(parts) == 1 else b"".join(parts))
                parts, byte, size = [], byte + size, 0
        if lacing and lacing[-1] == 255:
            parts.append(view[start + byte : start + byte + size])
            s["open"] = parts
        if granule >= 0 and not flags & FIRST:
            if s["granules"] and granule < s["granules"][-1]:
                raise OggError("granule positions fall")
            s["granules"].append(granule)
        s["ended"] = bool(flags & LAST)
        at = end
    if any(s["open"] is not None or not s["ended"] for s in streams.values()):
        raise OggError("a stream doesn't end")
    return streams


def read(media: bytes) -> tuple[bytes, int, list[float]]:
    """Payload, its text bytes, and the seconds at which the audio stream's pages end."""
    streams = decode(media)
    if set(streams) != {AUDIO, COMMENT}:
        raise OggError("other streams than expected")
    name, _, rate, bits, _ = _IDENT.unpack(streams[AUDIO]["packets"][0])
    if name != b"PCM8MONO" or bits != 8:
        raise OggError("the audio stream isn't 8-bit samples")
    payload = b"".join(streams[AUDIO]["packets"][1:])
    if streams[AUDIO]["granules"][-1] != len(payload):
        raise OggError("samples are missing")
    return payload, struct.unpack("<Q", streams[COMMENT]["packets"][1])[0], [g / rate for g in streams[AUDIO]["granules"]]


def feature(payload: bytes, seconds: list[float]) -> str:
    """Seconds, pages, mean and standard deviation of the samples around 128, and crossings of 128."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    mean = float((counts * level).sum() / len(x))
    spread = float(((counts * level * level).sum() / len(x) - mean * mean) ** 0.5)
    high = x >= 128
    return f"s={seconds[-1]:.3f};pages={len(seconds)};mean={mean:.4f};sd={spread:.4f};cross={int(np.count_nonzero(high[1:] != high[:-1]))}"


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media binary)``: each text of ``docs(doc_id, text)`` as an Ogg file.

    The UTF-8 bytes are padded with 255 to a positive multiple of FRAME. Null counts as empty. Rows repeat as
    they come; an empty table stays empty.
    """
    session(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, "text"):
            media = [encode(x + b"\xff" * (max(1, -(-len(x) // FRAME)) * FRAME - len(x)), len(x)) for x in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """Digests and features of ``media(doc_id, media)``, from the stored bytes alone. Null media give nulls; damaged media raise OggError."""
    session(media)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(x: bytes | None) -> tuple:
        if x is None:
            return (None,) * 7
        payload, n, seconds = read(x)
        return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(x), hashlib.sha256(x).hexdigest(), feature(payload, seconds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column("media")]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=[x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, schema)


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an Ogg file, read back."""
    return inspect(store(table(spark, sf_dir, "documents").select("doc_id", "text")))
