import gzip
import random

from tidewatch.llm import warc as W
from tidewatch.llm.common import read_blobs, shared_path


def record(i, payload=b"<p>x</p>", **more):
    return W.build_record(i, f"http://a/{i}", payload, W.digest(payload), more.get("refers_to"), "refers_to" in more)


def test_ids_round_trip():
    for i in (0, 1, 2**62, -5, None):
        assert W.page_of(W.record_id(i)) == i
    assert W.page_of("<urn:uuid:00000000-0000-0000-0000-000000000001>") is None
    assert W.page_of("nonsense") is None and W.page_of(None) is None


def test_members_are_ordinary_gzip():
    data = b"".join(W.gzip_member(record(i)) for i in range(3))
    assert gzip.decompress(data + b"\0") == b"".join(record(i) for i in range(3))


def test_salvage_of_damaged_members():
    rng = random.Random(1)
    parts = [W.gzip_member(record(i, bytes(rng.randrange(256) for _ in range(400)))) for i in range(20)]
    starts = [sum(map(len, parts[:i])) for i in range(21)]
    data = bytearray(b"".join(parts))
    data[starts[4] + 60] ^= 0xFF  # inside a member
    data[starts[9]] = 0  # its magic number
    whole = list(W.salvage(bytes(data[: starts[19] + 50])))  # and a cut at the end
    assert [f["page_id"] for k, _, f in whole if k == "record"] == [i for i in range(19) if i not in (4, 9)]
    gaps = [(at, n) for k, at, (n, _) in ((k, a, x) for k, a, x in whole if k == "gap")]
    assert gaps == [(starts[i], starts[i + 1] - starts[i]) for i in (4, 9)] + [(starts[19], 50)]


def test_salvage_of_plain_records():
    parts = [record(0), record(1, b"has WARC/1.1\r\nWARC-Type: response\r\n\r\n inside"), record(2), b"noise \x1f\x8b\x08 noise", record(3), record(4)]
    data = b"".join(parts)
    got = list(W.salvage(data))
    assert [f["page_id"] for k, _, f in got if k == "record"] == [0, 1, 2, 3, 4]
    assert [(at, x[0]) for k, at, x in got if k == "gap"] == [(len(b"".join(parts[:3])), len(parts[3]))]
    broken = data.replace(b"<p>x</p>", b"<p>y</p>", 1)  # the block digest fails
    got = list(W.salvage(broken))
    assert [f["page_id"] for k, _, f in got if k == "record"] == [1, 2, 3, 4]
    assert next(x for k, _, x in got if k == "gap") == (len(parts[0]), "block digest differs")
    assert list(W.salvage(b"")) == [] and list(W.salvage(b"\0\0")) == []


def test_round_trip(spark):
    same = "<p>é same</p>" * 50
    rows = [(7, "http://a/7 b\r\n", same), (3, None, same), (9, "u", same), (1, "u", None), (2, "u", ""), (5, "u", "x" * 300_000), (3, None, same)]
    rows += [(None, "n", same), (None, "n", "alone")] + [(i, "u", f"page {i}") for i in range(100, 160)]
    pages = spark.createDataFrame([(*r, 1, b"b") for r in rows], "page_id long, url string, html string, first int, payload binary")
    path = shared_path(spark, "warc")
    W.write_archives(pages.repartition(3), path, roll_bytes=2000)
    assert read_blobs(spark, path).count() > 3
    records, gaps = W.read_archives(spark, path)
    assert gaps.count() == 0
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in records.collect()), key=str)
    n = len(same.encode())
    want = [(7, "revisit", 3, n), (3, "response", None, n), (3, "response", None, n), (9, "revisit", 3, n), (None, "revisit", 3, n),
            (1, "response", None, 0), (2, "revisit", 1, 0), (5, "response", None, 300_000), (None, "response", None, 5)]
    want += [(i, "response", None, 8) for i in range(100, 160)]
    assert got == sorted(want, key=str)
    for r in records.filter("record_type = 'response'").collect():
        assert W.digest(r["payload"]) == r["payload_digest"]
    longer = shared_path(spark, "warc")
    W.write_archives(pages, longer, min_bytes=1)
    assert W.read_archives(spark, longer)[0].filter("page_id = 2 and record_type = 'response'").count() == 1
    empty = shared_path(spark, "warc")
    W.write_archives(pages.limit(0), empty)
    assert W.read_archives(spark, empty)[0].count() == 0


def test_salvage_inside_a_member():
    parts = [record(i, b"page %d " % i + random.Random(i).randbytes(3000)) for i in range(6)]
    pages = lambda data: [f["page_id"] for k, _, f in W.salvage(data) if k == "record"]
    for bad in (0, 3, 5):
        broken = [p.replace(b"page", b"pagf", 1) if i == bad else p for i, p in enumerate(parts)]
        data = W.gzip_member(b"".join(broken))
        assert pages(data) == [i for i in range(6) if i != bad]
        gaps = [x for k, _, x in W.salvage(data) if k == "gap"]
        assert gaps == [(0, f"block digest differs inside a member: {len(parts[bad])} bytes from {sum(map(len, parts[:bad]))}")]
    whole = W.gzip_member(b"".join(parts))
    cut = whole[: len(whole) * 3 // 4]
    assert pages(cut) == [0, 1, 2, 3]
    assert [(a, x[0]) for k, a, x in W.salvage(cut) if k == "gap"] == [(0, len(cut))]
    assert pages(cut + W.gzip_member(record(9))) == [0, 1, 2, 3, 9]


def test_digests_of_other_spelling_or_algorithm():
    plain = record(1)
    sha = W.digest(b"<p>x</p>")
    for other in ("sha256:abc", "blake3:1", "sha1:" + sha.lower(), "SHA1:" + sha, "sha1:" + W.base64.b32decode(sha).hex(),
                  "md5:" + W.hashlib.md5(b"<p>x</p>").hexdigest()):
        assert len([1 for k, *_ in W.salvage(plain.replace(f"Payload-Digest: sha1:{sha}".encode(), f"Payload-Digest: {other}".encode())) if k == "record"]) == 1
    wrong = plain.replace(f"Payload-Digest: sha1:{sha}".encode(), b"Payload-Digest: md5:" + b"0" * 32)
    assert [x[1] for k, _, x in W.salvage(wrong) if k == "gap"] == ["payload digest differs"]
