"""Media columns: texts stored losslessly in ISO base media files, and a reader of such files' boxes.

``to_media`` writes one track of fixed 64-byte samples of 8-bit units; ``probe`` walks the nested boxes of any
ISO media file, decodes its sample tables and reports codec, duration and keyframe byte ranges from the
headers alone; ``payload`` reads the sample bytes back through those tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64  # bytes of a sample
CHUNK = 16  # samples of a chunk; a chunk's first sample is a keyframe
TIMESCALE = 8000  # bytes played in a second
DEPTH = 32  # levels of boxes that are walked

#: Boxes that hold other boxes, with the bytes of header before them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}

#: Fixed value: the unit matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
_HDLR = box(b"hdlr", struct.pack(">II4s12x", 0, 0, b"soun"), b"text bytes\0")
_SMHD = box(b"smhd", struct.pack(">IHH", 0, 0, 0))
_DINF = box(b"dinf", box(b"dref", struct.pack(">II", 0, 1), box(b"url ", struct.pack(">I", 1))))
_STSD = box(b"stsd", struct.pack(">II", 0, 1), box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16)))


def to_media(data: bytes) -> bytes:
    """An ISO media file whose samples are ``data`` in order; its length must be a positive multiple of 64."""
    n = len(data) // UNIT
    if not n or len(data) % UNIT:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    chunks = -(-n // CHUNK)
    long = len(data) + 4096 + 16 * chunks >= 1 << 32
    duration = struct.pack(">Q", len(data))
    mvhd = box(b"mvhd", struct.pack(">IQQI", 0x01000000, 0, 0, TIMESCALE), duration, struct.pack(">IH10x", 0x10000, 0x100), MATRIX, struct.pack(">24xI", 2))
    tkhd = box(b"tkhd", struct.pack(">IQQII", 0x01000007, 0, 0, 1, 0), duration, struct.pack(">8xHHHH", 0, 0, 0x100, 0), MATRIX, struct.pack(">II", 0, 0))
    mdhd = box(b"mdhd", struct.pack(">IQQI", 0x01000000, 0, 0, TIMESCALE), duration, struct.pack(">HH", 0x55C4, 0))
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK if chunks > 1 else last)] + ([(chunks, last)] if chunks > 1 and last != CHUNK else [])
    stts = box(b"stts", struct.pack(">IIII", 0, 1, n, UNIT))
    stsc = box(b"stsc", struct.pack(">II", 0, len(runs)), *[struct.pack(">III", first, count, 1) for first, count in runs])
    stsz = box(b"stsz", struct.pack(">III", 0, UNIT, n))
    stss = box(b"stss", struct.pack(">II", 0, chunks), (np.arange(chunks, dtype=">u4") * CHUNK + 1).astype(">u4").tobytes())

    def moov(start: int) -> bytes:
        at = start + np.arange(chunks, dtype=np.int64) * (CHUNK * UNIT)
        offsets = box(b"co64" if long else b"stco", struct.pack(">II", 0, chunks), at.astype(">u8" if long else ">u4").tobytes())
        stbl = box(b"stbl", _STSD, stts, stsc, stsz, offsets, stss)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, _HDLR, box(b"minf", _SMHD, _DINF, stbl))))

    head = struct.pack(">I4sQ", 1, b"mdat", len(data) + 16) if long else struct.pack(">I4s", len(data) + 8, b"mdat")
    return b"".join((_FTYP, moov(len(_FTYP) + len(moov(0)) + len(head)), head, data))


def boxes(data, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of the boxes of one level; a box that runs past its parent is an error."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box header is cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} has a bad size")
        yield kind, body, start + size
        start += size


def walk(data, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box at any depth, parents first: (path of kinds, start of the body, end); over DEPTH levels are an error."""
    if len(path) > DEPTH:
        raise ValueError("boxes are nested too deeply")
    for kind, body, stop in boxes(data, start, end):
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body + CONTAINERS[kind], stop, (*path, kind))


def _expand(data, body: int, stop: int, kind: bytes) -> np.ndarray:
    """Sample sizes of an ``stsz`` or ``stz2`` box."""
    if kind == b"stsz":
        fixed, count = struct.unpack_from(">II", data, body + 4)
        if fixed:
            if fixed * count > len(data):
                raise ValueError("more samples than the file has bytes for")
            return np.full(count, fixed, dtype=np.int64)
        return np.frombuffer(data, ">u4", count, body + 12).astype(np.int64)
    field, count = struct.unpack_from(">3xBI", data, body + 4)
    if field == 16:
        return np.frombuffer(data, ">u2", count, body + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, (count * field + 7) // 8, body + 12)
    if field == 4:
        raw = np.stack([raw >> 4, raw & 15], axis=1).ravel()[:count]
    return raw.astype(np.int64)


def _offsets(sizes: np.ndarray, chunk_at: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Where each sample starts, from sample sizes, chunk offsets and the sample-to-chunk runs."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    per_chunk = np.zeros(len(chunk_at), np.int64)
    for k, (first, count, _) in enumerate(runs):
        until = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunk_at)
        if first < 1:
            raise ValueError("chunks are numbered from 1")
        per_chunk[first - 1 : until] = min(count, len(sizes))
    upto = np.cumsum(per_chunk)
    if not len(upto) or upto[-1] < len(sizes):
        raise ValueError("the sample tables place fewer samples than they size")
    firsts = np.concatenate(([0], upto[:-1]))
    chunk_of = np.searchsorted(upto, np.arange(len(sizes)), "right")
    before = np.cumsum(sizes) - sizes
    start_of_chunk = before[np.minimum(firsts, len(sizes) - 1)]
    return chunk_at[chunk_of] + before - start_of_chunk[chunk_of]


def probe(data: bytes) -> list[dict]:
    """One dict a track: codec, handler, timescale, duration, sample count, sample ranges, keyframe ranges.

    Payloads are not decoded; only box headers and sample tables are read. Ranges are arrays of
    (start, size) with neighbours joined for samples of one stretch.
    """
    tracks: list[dict] = []
    t: dict = {}
    for path, body, stop in walk(data):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            t = {"codec": None, "handler": None, "timescale": 0, "duration": 0, "stsz": np.zeros(0, np.int64), "stsc": [], "stco": np.zeros(0, np.int64), "stss": None, "stts": []}
            tracks.append(t)
        elif not t or path[:2] != (b"moov", b"trak"):
            continue
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, body + 20) if data[body] == 1 else struct.unpack_from(">II", data, body + 12)
        elif kind == b"hdlr":
            t["handler"] = data[body + 8 : body + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[body + 12 : body + 16].decode("latin-1")
        elif kind == b"stts":
            (n,) = struct.unpack_from(">I", data, body + 4)
            t["stts"] = np.frombuffer(data, ">u4", 2 * n, body + 8).reshape(-1, 2).astype(np.int64)
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", data, body + 4)
            t["stsc"] = np.frombuffer(data, ">u4", 3 * n, body + 8).reshape(-1, 3).astype(np.int64).tolist()
        elif kind in (b"stsz", b"stz2"):
            t["stsz"] = _expand(data, body, stop, kind)
        elif kind in (b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", data, body + 4)
            t["stco"] = np.frombuffer(data, ">u4" if kind == b"stco" else ">u8", n, body + 8).astype(np.int64)
        elif kind == b"stss":
            (n,) = struct.unpack_from(">I", data, body + 4)
            t["stss"] = np.frombuffer(data, ">u4", n, body + 8).astype(np.int64)
    out = []
    for t in tracks:
        at = _offsets(t["stsz"], t["stco"], t["stsc"])
        keys = np.arange(len(at)) if t["stss"] is None else t["stss"] - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= len(at)):
            raise ValueError("a keyframe is no sample of its track")
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1] + t["stsz"][:-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(t["stsz"], first) if len(first) else np.zeros(0, np.int64)
        played = int((np.asarray(t["stts"]).reshape(-1, 2).prod(axis=1)).sum()) if len(t["stts"]) else t["duration"]
        out.append({"codec": t["codec"], "handler": t["handler"], "timescale": t["timescale"], "duration": t["duration"] or played, "samples": len(at), "ranges": np.stack([at[first], total], 1), "keyframes": np.stack([at[keys], t["stsz"][keys]], 1)})
    return out


def payload(data: bytes, track: dict) -> bytes:
    """The sample bytes of a track, in order, read through its sample ranges."""
    view = memoryview(data)
    if any(a < 0 or a + n > len(view) for a, n in track["ranges"].tolist()):
        raise ValueError("a sample lies outside the file")
    return b"".join(view[a : a + n] for a, n in track["ranges"].tolist())


def encode_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text (null: empty) as UTF-8, padded, in an ISO media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_media(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, media binary")


def slices(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


TRACKS = "array<struct<codec:string,handler:string,timescale:long,duration:long,samples:long,keyframes:array<struct<start:long,size:long>>>>"


def probe_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """``(key, tracks, error)``: the tracks' codec, duration and keyframe byte ranges; ``error`` names what is
    wrong with a null, cut or broken file, whose ``tracks`` is then null."""
    kind = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))]))

    def one(data: bytes | None):
        if data is None:
            return None, "null"
        try:
            return [{k: t[k] for k in ("codec", "handler", "timescale", "duration", "samples")} | {"keyframes": [{"start": a, "size": n} for a, n in t["keyframes"].tolist()]} for t in probe(data)], None
        except (ValueError, struct.error, IndexError, OverflowError) as e:
            return None, str(e) or "broken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                got = [one(x) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.string())], [key, "tracks", "error"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, tracks {TRACKS}, error string")


def text_media_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a media file, read the stored bytes back and describe them.

    Null and empty texts are 64 zero bytes. Equal texts give equal values; repeated rows are described each; an
    empty table gives an empty result; other columns are not read. ``feature`` is
    ``codec:timescale:duration:samples:keyframes:crc32 of the keyframes' (start, size) table``; ``codec``,
    ``duration`` (in units of the time scale) and ``keyframes`` (byte ranges of the stored form) follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                cols: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
                frames: list[np.ndarray] = []
                for raw in b.column(1).cast(pa.binary()).to_pylist():
                    raw = raw or b""
                    media = to_media(padded(raw))
                    (track,) = probe(media)
                    back = payload(media, track)
                    table = zlib.crc32(track["keyframes"].astype(">u8").tobytes())
                    feature = f"{track['codec'].strip()}:{track['timescale']}:{track['duration']}:{track['samples']}:{len(track['keyframes'])}:{table:08x}"
                    for c, v in zip(cols, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, track["codec"].strip(), track["duration"])):
                        c.append(v)
                    frames.append(track["keyframes"])
                flat = np.concatenate(frames)
                ranges = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "size"])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in frames]))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds), pa.ListArray.from_arrays(offsets, ranges)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, keyframes array<struct<start:long,size:long>>")
