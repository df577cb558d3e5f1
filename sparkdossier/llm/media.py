"""Media columns: ISO base media containers.

``walk`` goes through nested boxes and ``tracks`` decodes the tables of each track (sizes, chunks, offsets, times, sync samples,
edits, and the runs of fragments) without touching a payload byte. ``build`` writes a container whose one video track holds uncompressed 8-bit
grey frames of 24 x 24 samples, so that any bytes of a multiple of 576 are stored without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
WIDTH = HEIGHT = 24
#: Frames a second, and every how many frames a sync sample is marked.
RATE, SYNC = 25, 12
FRAMES_PER_CHUNK = 64

#: Boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf")
#: Fixed value: the unity matrix of movie and track headers.
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, flags: int, *content: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *content)


def build(payload: bytes) -> bytes:
    """A container for ``payload``, whose length is a positive multiple of 576."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    last = n - (chunks - 1) * FRAMES_PER_CHUNK
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), b"\x04grey".ljust(32, b"\0"), struct.pack(">Hh", 8, -1)
    )
    runs = [(1, FRAMES_PER_CHUNK)] if chunks > 1 else []
    if not runs or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last))
    sync = range(1, n + 1, SYNC)

    def moov(first: int) -> bytes:
        offsets = [first + i * FRAMES_PER_CHUNK * FRAME for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", 0, struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), stbl)
        mdhd = full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
        hdlr = full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"text\0")
        tkhd = full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
        mvhd = full(b"mvhd", 0, struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    size = len(moov(0))
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    out = moov(len(ftyp) + size + head)
    if len(out) != size:  # offsets beyond 32 bits made the table wider
        out = moov(len(ftyp) + len(out) + head)
    return ftyp + out + box(b"mdat", payload)


def walk(data: bytes | memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """``(path, start of content, end)`` of every box, parents before children; only headers are read."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1:
            if at + 16 > end:
                raise Damaged("a box ends within its header")
            size, start = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < start or stop > end:
            raise Damaged(f"box {kind!r} does not fit in what holds it")
        yield (*path, kind), start, stop
        if kind in CONTAINERS:
            yield from walk(data, start, stop, (*path, kind))
        at = stop


class Damaged(ValueError):
    """A container whose boxes or tables do not fit together."""


def _ints(data, at: int, n: int, end: int, kind: str = ">u4") -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise Damaged("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _small_sizes(data, a: int, z: int) -> np.ndarray:
    """Sizes of a compact table: 4, 8 or 16 bits each."""
    bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits == 4:
        pairs = _ints(data, a + 12, -(-n // 2), z, "u1")
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
    if bits not in (8, 16):
        raise Damaged(f"sample sizes of {bits} bits")
    return _ints(data, a + 12, n, z, "u1" if bits == 8 else ">u2")


def _edits(data, a: int, z: int) -> list[tuple[int, int]]:
    """Entries of an edit list: duration in the movie's timescale and media time (-1 for an empty edit)."""
    wide, n = data[a] == 1, struct.unpack_from(">I", data, a + 4)[0]
    size = 20 if wide else 12
    if a + 8 + n * size > z:
        raise Damaged("a table is longer than its box")
    return [struct.unpack_from(">Qq" if wide else ">Ii", data, a + 8 + i * size) for i in range(n)]


#: Sample flags that say a sample depends on others.
NOT_SYNC = 0x10000


def _run(data, a: int, z: int, head: dict, base: int) -> tuple[dict, int]:
    """A fragment's run of samples: sizes, offsets, durations and sync flags, and where its data ends."""
    flags, n = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
    at = a + 8
    if flags & 1:
        base, at = head["base"] + struct.unpack_from(">i", data, at)[0], at + 4
    first = None
    if flags & 4:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    # What the run says is held against the file before anything of that length is made.
    if "size" not in fields and n and not 0 < head.get("size", 0) * n <= len(data) - max(base, 0):
        raise Damaged("a run of samples ends beyond the file")
    table = _ints(data, at, n * len(fields), z).reshape(n, len(fields)) if fields else None
    sizes = table[:, fields.index("size")] if "size" in fields else np.full(n, head.get("size", 0), np.int64)
    ticks = int(table[:, fields.index("duration")].sum()) if "duration" in fields else n * head.get("duration", 0)
    if "flags" in fields:
        sync = np.flatnonzero(table[:, fields.index("flags")] & NOT_SYNC == 0)
    else:
        own = [head.get("flags", 0) if first is None else first][:n]
        sync = np.arange(1, n) if n > 1 and not head.get("flags", 0) & NOT_SYNC else np.zeros(0, np.int64)
        sync = np.concatenate(([0] if own and not own[0] & NOT_SYNC else [], sync)).astype(np.int64)
    begin = base + np.cumsum(sizes) - sizes
    end = base + int(sizes.sum())
    if end > len(data) or base < 0:
        raise Damaged("a run of samples ends beyond the file")
    return {"sizes": sizes, "offsets": begin, "ticks": ticks, "sync": sync}, end


def _read(data) -> list[dict]:
    out: list[dict] = []
    defaults: dict[int, dict] = {}
    head: dict = {}
    fragment, next_at = 0, 0
    for path, a, z in walk(data):
        kind = path[-1]
        if kind == b"trak" and path[-2:] == (b"moov", b"trak"):
            out.append({"sync": None, "id": len(out) + 1, "runs_of": []})
        elif kind == b"mvhd":
            movie = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            defaults["movie"] = {"timescale": movie}
        elif kind == b"trex":
            number, _, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
            defaults[number] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            fragment, next_at = next(s for s in (a - 8, a - 16) if data[s + 4 : s + 8] == b"moof"), None
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", data, a)
            at, head = a + 8, dict(defaults.get(number, {}), id=number, base=fragment)
            if flags & 1:
                head["base"], at = struct.unpack_from(">Q", data, at)[0], at + 8
            elif not flags & 0x20000 and next_at is not None:
                head["base"] = next_at  # where the data of the fragment's track before it ends
            at += 4 if flags & 2 else 0
            for bit, name in ((8, "duration"), (16, "size"), (32, "flags")):
                if flags & bit:
                    head[name], at = struct.unpack_from(">I", data, at)[0], at + 4
            run_at = head["base"]
        elif kind == b"trun":
            track = next((t for t in out if t["id"] == head.get("id")), None)
            if track is None:
                raise Damaged("a fragment of an unknown track")
            run, run_at = _run(data, a, z, head, run_at)
            next_at = run_at
            track["runs_of"].append(run)
        if not out or b"trak" not in path:
            continue
        t = out[-1]
        if kind == b"tkhd":
            t["id"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"hdlr":
            t["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1") if z - a >= 16 else ""
        elif kind == b"stts":
            pairs = _ints(data, a + 8, 2 * struct.unpack_from(">I", data, a + 4)[0], z).reshape(-1, 2)
            t["timed"], t["times"] = int(pairs[:, 0].sum()), sum(n * d for n, d in pairs.tolist())
        elif kind == b"ctts":
            pairs = _ints(data, a + 8, 2 * struct.unpack_from(">I", data, a + 4)[0], z, ">i4" if data[a] == 1 else ">u4").reshape(-1, 2)
            t["shifts"] = int((pairs[:, 0] & 0xFFFFFFFF).sum())
        elif kind == b"elst":
            t["edits"] = _edits(data, a, z)
        elif kind == b"stss":
            t["sync"] = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], z) - 1
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", data, a + 4)
            if each and n * each > len(data):
                raise Damaged("more samples than the file holds")
            t["sizes"] = np.full(n, each, np.int64) if each else _ints(data, a + 12, n, z)
        elif kind == b"stz2":
            t["sizes"] = _small_sizes(data, a, z)
        elif kind == b"stsc":
            t["runs"] = _ints(data, a + 8, 3 * struct.unpack_from(">I", data, a + 4)[0], z).reshape(-1, 3)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], z, ">u4" if kind == b"stco" else ">u8")
    for t in out:
        _lay_out(t, defaults.get("movie", {}).get("timescale", 0), len(data))
    return out


def _lay_out(t: dict, movie: int, end: int) -> None:
    """Offsets of a track's samples from its tables, then those of its fragments."""
    for name in ("codec", "handler", "timescale", "duration"):
        if name not in t:
            raise Damaged(f"a track has no {name}")
    if not t["timescale"]:
        raise Damaged("a track's timescale is 0")
    for name, what in (("shifts", "time shifts"), ("timed", "durations")):
        if t.get(name, len(t.get("sizes", ()))) != len(t.get("sizes", ())):
            raise Damaged(f"{what} are not as many as samples")
    sizes, chunks, runs = (t.get(k, np.zeros(0, np.int64)) for k in ("sizes", "chunks", "runs"))
    runs = runs.reshape(-1, 3)
    firsts = runs[:, 0]
    if len(runs) and (firsts[0] != 1 or (np.diff(firsts) <= 0).any() or firsts[-1] > len(chunks)):
        raise Damaged("runs of chunks are not in order")
    per = np.repeat(runs[:, 1], np.diff(np.append(firsts, len(chunks) + 1))) if len(runs) else np.zeros(len(chunks), np.int64)
    if int(per.sum()) != len(sizes) or len(sizes) > end:
        raise Damaged("the chunks do not hold as many samples as there are sizes")
    begin = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    full = per > 0
    within = begin - np.repeat(begin[first[full]], per[full])
    offsets = np.repeat(chunks, per) + within
    sync = np.arange(len(sizes)) if t["sync"] is None else t["sync"]
    if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
        raise Damaged("a sync sample that is not there")
    ticks = 0
    for run in t.pop("runs_of"):
        sync = np.concatenate((sync, run["sync"] + len(sizes)))
        sizes, offsets, ticks = np.concatenate((sizes, run["sizes"])), np.concatenate((offsets, run["offsets"])), ticks + run["ticks"]
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > end):
        raise Damaged("a sample lies beyond the file")
    t["sizes"], t["offsets"], t["sync"] = sizes, offsets, sync
    t["duration"] = t["duration"] or t.get("times", 0)
    t["duration"] += ticks
    # What is shown: the edits' lengths, else all of it.
    shown = sum(d for d, at in t.get("edits", ()) if at >= 0)
    t["shown_seconds"] = shown / movie if shown and movie else t["duration"] / t["timescale"]


def tracks(data: bytes) -> list[dict]:
    """For each track: handler, codec, timescale, duration, sample sizes and offsets, and which samples are in sync.

    Samples of fragments (``moof``) follow those of the tables. Whatever does not fit raises ``Damaged``.
    """
    try:
        return _read(data)
    except Damaged:
        raise
    except (struct.error, IndexError, ValueError, StopIteration, OverflowError, RecursionError, MemoryError) as e:
        raise Damaged(str(e) or type(e).__name__) from e


def keyframes(track: dict) -> list[tuple[int, int]]:
    """Byte ranges ``(offset, length)`` of the sync samples."""
    at = track["sync"]
    return list(zip(track["offsets"][at].tolist(), track["sizes"][at].tolist(), strict=True))


def samples(data: bytes, track: dict) -> bytes:
    """The track's samples one after the other; neighbours in the file are read at once."""
    o, s = track["offsets"], track["sizes"]
    if not len(o):
        return b""
    cut = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    starts, ends = o[np.concatenate(([0], cut))], (o + s)[np.concatenate((cut - 1, [len(o) - 1]))]
    return b"".join(data[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True))


def feature(track: dict) -> str:
    """Codec, duration in ms, counts and a checksum of the key frames' byte ranges."""
    keys = keyframes(track)
    ranges = zlib.crc32(np.array(keys, "<i8").tobytes())
    ms = 1000 * track["duration"] // track["timescale"]
    return f"codec={track['codec'].strip()};handler={track['handler']};duration_ms={ms};samples={len(track['sizes'])};keyframes={len(keys)};first_key={"+".join(map(str, keys[0])) if keys else "none"};ranges={ranges:08x}"


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


#: Bytes of texts or containers that are worked on at once; a larger one is worked on alone.
BATCH_BYTES = 8 << 20


def _batches(make):
    """Runs ``make`` on pieces of a batch that hold about ``BATCH_BYTES`` in their second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                held = ends[at - 1] if at else 0
                end = min(max(at + 1, int(np.searchsorted(ends, held + BATCH_BYTES, "right"))), at + 500)
                yield make(batch.slice(at, end - at))
                at = end

    return run


def _store(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = [build(pad((x or "").encode())) for x in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each text's bytes as a container; a null text is an empty one, of one frame."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_batches(_store), "doc_id long, media binary")


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows: list[list] = [[] for _ in range(6)]
    for data in batch.column(1).to_pylist():
        found, error = [], None
        if data is not None:
            try:
                found = tracks(data)
            except Damaged as e:
                error = str(e)
        for x, y in zip(rows, (
            [t["codec"] for t in found], [t["duration"] / t["timescale"] for t in found], [t["shown_seconds"] for t in found], [len(t["sizes"]) for t in found],
            [[{"offset": a, "length": n} for a, n in keyframes(t)] for t in found], error,
        ), strict=True):
            x.append(y)
    span = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
    kinds = (pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.list_(span)), pa.string())
    names = ["doc_id", "codecs", "seconds", "shown_seconds", "n_samples", "keyframes", "error"]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))], names)


def describe_media(media: DataFrame) -> DataFrame:
    """``doc_id, codecs, seconds, shown_seconds, n_samples, keyframes, error`` of each container, an entry per track.

    Nothing but box headers and sample tables is read, fragments' too. ``seconds`` is the media's length, ``shown_seconds`` that
    of its edit list. A null container has no tracks. One whose boxes or tables do not fit has none either, and says why in
    ``error``, null for all others; no container stops the job. Repeated rows and null ids give a row each.
    """
    m = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media"))
    schema = (
        "doc_id long, codecs array<string>, seconds array<double>, shown_seconds array<double>, n_samples array<long>, "
        "keyframes array<array<struct<offset: long, length: long>>>, error string"
    )
    return m.mapInArrow(_batches(_describe), schema)


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for data in batch.column(1).to_pylist():
        if data is None:
            rows.append((None,) * 7)
            continue
        try:
            track = next(iter(tracks(data)), None)
            if track is None:
                raise Damaged("no track")
        except Damaged as e:
            rows.append((None, None, None, None, len(data), hashlib.sha256(data).hexdigest(), f"error={e}"))
            continue
        got = samples(data, track)
        n = len(got) - FRAME + len(got[-FRAME:].rstrip(b"\xff"))  # no UTF-8 text holds a byte 255
        rows.append((n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", *names])


def digest_media(media: DataFrame) -> DataFrame:
    """Digests of the payload that is read back from each container by its sample table, of the container, and a feature.

    Repeated rows and null ids give a row each; equal texts give equal values. A null container has nulls alone; one that is
    damaged or has no track has nulls for the payload and says why in ``feature``.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "media").mapInArrow(_batches(_digest), schema)
