"""Media columns: texts stored in ISO base media files, and container metadata read back without decoding payloads.

``write_container`` puts a payload into a file of the ISO base media format (ISO/IEC 14496-12): ``ftyp``, ``moov``
with one track of raw 8-bit frames, ``mdat``. ``read_container`` walks the nested boxes of any such file, decodes the
sample tables (``stts``, ``stsc``, ``stsz``, ``stco``/``co64``, ``stss``) and gives codec, duration and the byte
ranges of keyframes; the payload itself is only sliced, never decoded.

Defined results: a null or empty text is the empty payload and is padded to one frame; a file without a track has
codec null, duration 0 and no ranges; a truncated file or one whose tables disagree raises ``ValueError`` in
``read_container`` and gives a row with ``error`` set in ``probe_media``. Repeated rows give repeated results, an
empty table an empty one. Columns other than the key and the text or file take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.runtime import sliced

FRAME = 64  #: bytes of a frame: 8 x 8 grey samples of 8 bits
KEY_EVERY = 30  #: every so many frames one is a sync sample
CHUNK_FRAMES = 256  #: frames of a chunk
TIMESCALE = 600
FRAME_TICKS = 20
CODEC = b"raw "
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"})
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = 8 + len(body)
    if size > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, size + 8) + body
    return struct.pack(">I4s", size, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _tables(count: int, first: int) -> bytes:
    """The sample tables of ``count`` equal frames that start at byte ``first``."""
    whole, rest = divmod(count, CHUNK_FRAMES)
    runs = [(1, CHUNK_FRAMES, 1)] * bool(whole) + [(whole + 1, rest, 1)] * bool(rest)
    chunks = range(first, first + count * FRAME, CHUNK_FRAMES * FRAME)
    wide = first + count * FRAME > 0xFFFFFFFF
    sync = range(1, count + 1, KEY_EVERY)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    return box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, count, FRAME_TICKS)),
        full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, count)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{len(chunks)}{'Q' if wide else 'I'}", len(chunks), *chunks)),
    )


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the frame size."""
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def write_container(payload: bytes) -> bytes:
    """A file whose one track holds ``payload``, a positive multiple of 64 bytes, one frame after the other."""
    count, rest = divmod(len(payload), FRAME)
    if rest or not count:
        raise ValueError("the payload must be a positive multiple of the frame size")
    ticks = count * FRAME_TICKS
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks & 0xFFFFFFFF), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0")
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, _tables(count, first))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 <= 0xFFFFFFFF else 16
    size = len(moov(0))
    first = len(ftyp) + size + head
    index = moov(first)
    if len(index) != size:  # offsets became 64 bits wide
        first += len(index) - size
        index = moov(first)
    return b"".join((ftyp, index, box(b"mdat", payload)))


@dataclass
class Track:
    codec: str | None = None
    timescale: int = 0
    ticks: int = 0
    samples: int = 0
    keyframes: list[tuple[int, int]] = field(default_factory=list)  #: (offset, length) of sync samples
    ranges: list[tuple[int, int]] = field(default_factory=list)  #: (offset, length) of runs of samples that touch

    @property
    def duration(self) -> float:
        return self.ticks / self.timescale if self.timescale else 0.0


def boxes(data: memoryview, start: int, end: int):
    """(kind, body start, body end) of each box between two offsets."""
    while start < end:
        if end - start < 8:
            raise ValueError(f"box header cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"box header cut off at {start}")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield kind, body, start + size
        start += size


def _numbers(data: memoryview, at: int, end: int, count: int, code: str) -> tuple[int, ...]:
    """``count`` big-endian numbers; a count that the box cannot hold is an error, not a read past its end."""
    if at + count * struct.calcsize(">" + code) > end:
        raise ValueError("table longer than its box")
    return struct.unpack_from(f">{count}{code}", data, at)


def _sample_table(data: memoryview, start: int, end: int, track: Track) -> None:
    found = {kind: (a, b) for kind, a, b in boxes(data, start, end)}
    word = lambda kind, skip: _numbers(data, found[kind][0] + skip, found[kind][1], 1, "I")[0]
    if b"stsd" in found and word(b"stsd", 4):
        a, b = found[b"stsd"]
        track.codec = next(boxes(data, a + 8, b))[0].decode("latin-1")
    if b"stts" in found:
        a, b = found[b"stts"]
        flat = _numbers(data, a + 8, b, 2 * word(b"stts", 4), "I")
        track.ticks = sum(n * d for n, d in zip(flat[::2], flat[1::2])) or track.ticks
    if b"stsz" not in found or not found.keys() & {b"stco", b"co64"} or b"stsc" not in found:
        return
    a, b = found[b"stsz"]
    same, count = word(b"stsz", 4), word(b"stsz", 8)
    sizes = None if same else _numbers(data, a + 12, b, count, "I")
    kind, code = (b"co64", "Q") if b"co64" in found else (b"stco", "I")
    chunks = _numbers(data, found[kind][0] + 8, found[kind][1], word(kind, 4), code)
    a, b = found[b"stsc"]
    flat = _numbers(data, a + 8, b, 3 * word(b"stsc", 4), "I")
    runs = list(zip(flat[::3], flat[1::3]))
    sync = None
    if b"stss" in found:
        sync = set(_numbers(data, found[b"stss"][0] + 8, found[b"stss"][1], word(b"stss", 4), "I"))
    number, run = 0, 0
    for index, at in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= index:
            run += 1
        for _ in range(min(runs[run][1] if runs else 0, count - number)):
            size = same or sizes[number]
            number += 1
            if at + size > len(data):
                raise ValueError(f"sample {number} lies past the end of the file")
            if sync is None or number in sync:
                track.keyframes.append((at, size))
            if track.ranges and sum(track.ranges[-1]) == at:
                track.ranges[-1] = (track.ranges[-1][0], track.ranges[-1][1] + size)
            else:
                track.ranges.append((at, size))
            at += size
    if number != count:
        raise ValueError(f"the chunks hold {number} of {count} samples")
    track.samples = count


def read_container(data: bytes) -> list[Track]:
    """The tracks of a file, from its boxes alone; boxes may be nested to any depth."""
    view, tracks = memoryview(data), []
    try:
        levels = [boxes(view, 0, len(view))]
        while levels:
            kind, a, b = next(levels[-1], (None, 0, 0))
            if kind is None:
                levels.pop()
                continue
            if kind == b"trak":
                tracks.append(Track())
            if kind == b"mdhd" and tracks:
                wide = view[a] == 1
                tracks[-1].timescale = struct.unpack_from(">I", view, a + (20 if wide else 12))[0]
                tracks[-1].ticks = struct.unpack_from(">Q" if wide else ">I", view, a + (24 if wide else 16))[0]
            elif kind == b"stbl" and tracks:
                _sample_table(view, a, b, tracks[-1])
            elif kind in CONTAINERS:
                levels.append(boxes(view, a, b))
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"broken container: {e}") from e
    return tracks


def payload_of(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in order."""
    return b"".join(data[a : a + n] for a, n in track.ranges)


PROBE = "codec string, duration double, samples long, keyframes array<struct<offset:long,length:long>>, error string"


def probe_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Codec, duration and keyframe ranges of the first track of each file in a binary column.

    A null or empty file has codec null and no ranges. A broken file has ``error`` set and all else null.
    """
    chosen = media.select(key, column)
    schema = f"{chosen.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, {PROBE}"

    def probe(batches):
        for batch in sliced(batches, column):
            rows = []
            for data in batch.column(1):
                try:
                    track = (read_container(data.as_py() or b"") or [Track()])[0]
                    keys = [{"offset": a, "length": n} for a, n in track.keyframes]
                    rows.append((track.codec, track.duration, track.samples, keys, None))
                except ValueError as e:
                    rows.append((None, None, None, None, str(e)))
            ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
            kinds = (pa.string(), pa.float64(), pa.int64(), ranges, pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "codec", "duration", "samples", "keyframes", "error"])

    return chosen.mapInArrow(probe, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``: each whole text as a container."""
    def store(batches):
        for batch in sliced(batches):
            media = [write_container(pad((t or "").encode())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, media binary")


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def digest_row(text: str | None) -> tuple:
    """Write one text, read it back, and describe what was read."""
    raw = (text or "").encode()
    media = write_container(pad(raw))
    track = read_container(media)[0]
    payload = payload_of(media, track)
    keys = ",".join(f"{a}+{n}" for a, n in track.keyframes)
    feature = f"codec={track.codec};duration={track.ticks}/{track.timescale};samples={track.samples};keyframes={keys}"
    sha = hashlib.sha256
    return len(raw), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha(media).hexdigest(), feature


def media_digests(docs: DataFrame) -> DataFrame:
    """Contract rows: every text through the container and back, with digests of both forms.

    One narrow pass; container and payload of a text live only while its row is made.
    """
    def digest(batches):
        for batch in sliced(batches):
            rows = [digest_row(t) for t in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = [part.split()[0] for part in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(digest, DIGEST)
