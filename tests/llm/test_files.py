import hashlib
import random
import struct
import zlib

import pytest
import zstandard
from sparkdossier.llm import media, warc


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n long")


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "x" * 2000, "<p>y"
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (4, "u", small), (6, "u", small), (7, "u", None), (8, "u", ""), (None, "u", "<b>"), (9, "u", "é" * 50_000), (5, "again", big)]
    folder = warc.write_archives(page_rows(spark, [(*r, "d", 1) for r in rows]), f"file://{tmp_path}/w")
    got = warc.read_archives(spark, folder, payloads=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to) for i in (1, 3) for r in by[i]] == [("revisit", 5), ("revisit", 5)]
    assert all(r.record_type == "response" and r.refers_to is None for i in (4, 5, 6, 7, 8, 9, None) for r in by[i])
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert all(r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest() for r in by[page_id])
        assert all(r.payload is None or bytes(r.payload) == raw for r in by[page_id])
    for p in tmp_path.glob("w/*.zst"):
        raw = p.read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        assert d.decompressobj().decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert sorted((r.page_id or 0, r.url or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)


def test_urls_come_back_as_they_are(spark, tmp_path, monkeypatch):
    """Also where repeated payloads are too many to broadcast."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    urls = [None, "", "http://a/b c", " x\r\ny: z", "http://é/\u2028", "http://a?q=%20"]
    folder = warc.write_archives(page_rows(spark, [(i, u, "z" * 1500, "d", 1) for i, u in enumerate(urls)]), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert [got[i].url for i in range(6)] == urls and [got[i].refers_to for i in range(6)] == [5] * 5 + [None]


def test_a_second_attempt_leaves_the_first_alone(tmp_path):
    """Two attempts of a task write archives of their own; each list reads back its own rows."""
    import pyarrow as pa

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return self.attempt

    listed = []
    for attempt, ids in ((10, [1, 2, 3]), (11, [3, 1])):
        warc.TaskContext.get, before = staticmethod(lambda a=attempt: Task(a)), warc.TaskContext.get
        try:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(["u"] * len(ids)), pa.array(["h"] * len(ids)), pa.array([hashlib.sha1(b"h").hexdigest()] * len(ids)), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.string())],
                ["page_id", "url", "html", "digest", "refers_to", "refers_url"],
            )
            listed += warc._writer(f"file://{tmp_path}", "2024-01-01T00:00:00Z")(iter([batch]))
        finally:
            warc.TaskContext.get = before
    assert len({x.column(0)[0].as_py() for x in listed}) == 2
    for x, want in zip(listed, ([1, 2, 3], [3, 1])):
        assert [i for y in warc._reader(f"file://{tmp_path}", False)(iter([x])) for i in y.column(0).to_pylist()] == want


def test_warc_empty(spark, tmp_path):
    folder = warc.write_archives(page_rows(spark, []), f"file://{tmp_path}/w")
    assert warc.read_archives(spark, folder).count() == 0


def test_dictionary_is_trained_and_helps():
    r = random.Random(1)
    rows = [warc.record("response", i, i, "http://a", "2024-01-01T00:00:00Z", ("<html><body class=x>" + " ".join(r.choice("abcdefgh") * 4 for _ in range(60))).encode(), "0" * 40, None) for i in range(400)]
    d = warc.build_dictionary(rows)
    plain, with_it = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(dict_data=d)
    assert sum(len(with_it.compress(x)) for x in rows) < 0.8 * sum(len(plain.compress(x)) for x in rows)


def test_container_round_trip():
    for n in (1, 2, 63, 64, 65, 300):
        raw = random.Random(n).randbytes(n * media.FRAME)
        data = media.build(raw)
        (track,) = media.tracks(data)
        assert media.samples(data, track) == raw
        assert track["codec"] == "raw " and track["duration"] == n == track["times"] and len(track["sizes"]) == n
        assert all(data[a : a + m] == raw[i * 576 * media.SYNC :][:576] for i, (a, m) in enumerate(media.keyframes(track)))
        names = [p[-1] for p, _, _ in media.walk(data)]
        assert names[:2] == [b"ftyp", b"moov"] and names[-1] == b"mdat" and b"stss" in names


def test_media_of_odd_rows(spark, odd_docs, no_docs):
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.select("doc_id", "text").collect()]
    stored = media.store_texts(odd_docs)
    got = media.digest_media(stored).collect()
    want = sorted((i is not None, i or 0, len(x), hashlib.sha256(media.pad(x)).hexdigest(), zlib.crc32(media.pad(x)[-32:])) for i, x in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.codecs == ["raw "] and len(r.keyframes) == 1 for r in media.describe_media(stored).collect())
    assert media.digest_media(media.store_texts(no_docs)).count() == 0


def fragmented(parts, sync_first=True):
    """An empty movie and a fragment for each list of samples."""
    b, f = media.box, media.full
    mdhd = f(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 50, 0, 0x55C4, 0))
    stbl = b(b"stbl", f(b"stsd", 0, struct.pack(">I", 1), b(b"avc1", bytes(78))), *(f(k, 0, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")), f(b"stsz", 0, struct.pack(">II", 0, 0)))
    trak = b(b"trak", f(b"tkhd", 3, struct.pack(">III", 0, 0, 9), bytes(68)), b(b"mdia", mdhd, f(b"hdlr", 0, bytes(4), b"vide", bytes(13)), b(b"minf", stbl)))
    mvex = b(b"mvex", f(b"trex", 0, struct.pack(">5I", 9, 1, 2, 0, media.NOT_SYNC)))
    out = b(b"ftyp", b"isom", bytes(4)) + b(b"moov", f(b"mvhd", 0, struct.pack(">IIII", 0, 0, 50, 0), bytes(80)), trak, mvex)
    for samples in parts:
        def moof(offset, samples=samples):
            run = struct.pack(">IiI", len(samples), offset, 0) + b"".join(struct.pack(">I", len(x)) for x in samples)
            return b(b"moof", f(b"mfhd", 0, bytes(4)), b(b"traf", f(b"tfhd", 0x20000, struct.pack(">I", 9)), f(b"trun", 0x205, run)))
        out += moof(len(moof(0)) + 8) + b(b"mdat", *samples)
    return out


def test_fragments():
    parts = [[b"key0", b"a", b"bb"], [b"key1", b"cc"]]
    data = fragmented(parts)
    (track,) = media.tracks(data)
    assert media.samples(data, track) == b"".join(x for p in parts for x in p)
    assert [data[a : a + n] for a, n in media.keyframes(track)] == [b"key0", b"key1"]
    assert track["codec"] == "avc1" and track["duration"] == 10


def test_compact_sizes_and_edits():
    packed = media.full(b"stz2", 0, b"\0\0\0\x04", struct.pack(">I", 3), b"\x12\x30")[8:]
    assert media._small_sizes(packed, 0, len(packed)).tolist() == [1, 2, 3]
    elst = media.full(b"elst", 0, struct.pack(">I", 2), struct.pack(">Iii", 5, -1, 1), struct.pack(">Iii", 20, 0, 1))[8:]
    assert media._edits(elst, 0, len(elst)) == [(5, -1), (20, 0)]


def test_damaged_containers_are_rows_with_an_error(spark):
    """Whatever byte is cut or changed, the job goes on and the other rows are right."""
    good = media.build(media.pad(b"x" * 5000))
    r = random.Random(5)
    bad = [good[: r.randrange(1, len(good))] for _ in range(60)] + [b"", b"junk", bytes(200), b"\0\0\0\x08moov" * 3]
    for _ in range(200):
        x = bytearray(good)
        x[r.randrange(0, 700)] = r.randrange(256)
        bad.append(bytes(x))
    for gone in (b"stsd", b"mdhd", b"hdlr"):
        bad.append(good.replace(gone, b"free", 1))
    bad.append(good.replace(struct.pack(">IIHH", media.RATE, 9, 0x55C4, 0), struct.pack(">IIHH", 0, 9, 0x55C4, 0)))
    rows = [(0, good), (1, None), *((i, x) for i, x in enumerate(bad, 2))]
    got = {x.doc_id: x for x in media.describe_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(got) == len(rows) and got[0].codecs == ["raw "] and got[0].error is None and got[1].codecs == [] and got[1].error is None
    assert all(x.codecs == [] for x in got.values() if x.error) and all(got[len(rows) - i].error for i in (1, 2, 3, 4))


def test_counts_are_held_against_the_file_before_they_are_used(spark):
    import resource

    whole = media.build(media.pad(b"abc"))
    boxes = {path[-1]: (a, z) for path, a, z in media.walk(whole)}

    def with_box(kind, content):
        """The container with a box put into the sample table, its parents' sizes made to fit."""
        extra, out = media.box(kind, content), bytearray(whole)
        at = boxes[b"stbl"][1]
        out[at:at] = extra
        for parent in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            a = boxes[parent][0] - 8
            out[a : a + 4] = (int.from_bytes(out[a : a + 4], "big") + len(extra)).to_bytes(4, "big")
        return bytes(out)

    many = (4_000_000_000).to_bytes(4, "big")
    cases = [with_box(b"ctts", bytes(4) + (1).to_bytes(4, "big") + many + bytes(4)), with_box(b"stts", bytes(4) + (1).to_bytes(4, "big") + many + many)]
    # A fragment whose run names four thousand million samples, of a constant size and of none.
    for size in (0, 1):
        tfhd = media.box(b"tfhd", (0x10).to_bytes(4, "big") + (1).to_bytes(4, "big") + size.to_bytes(4, "big"))
        trun = media.box(b"trun", bytes(4) + many)
        cases.append(whole + media.box(b"moof", media.box(b"traf", tfhd, trun)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for data in cases:
        with pytest.raises(media.Damaged):
            media.tracks(data)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB
    rows = spark.createDataFrame([(1, None), (2, cases[0]), (3, b""), (4, whole), (5, whole[:40])], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.digest_media(rows).collect()}
    assert len(got) == 5 and got[1].media_bytes is None and got[1].feature is None
    assert got[4].n_bytes == 3 and got[4].payload_bytes == 576
    assert all(got[i].payload_sha256 is None and got[i].feature.startswith("error=") for i in (2, 3, 5))
