import base64
import gzip
import hashlib
import io
import random

from symloom.llm.warc import Gap, Record, member, record, salvage, write_archives

SCHEMA = "page_id long, url string, html string, file string, offset string, block string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", "o", "b") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_every_page_is_read_back(spark):
    rows = [(1, "http://a", "<p>one</p>"), (2, None, None), (3, "http://c\r\nX: y", ""), (4, "u", "<p>one</p>"), (9, "u", "<p>one</p>"), (9, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "x" * 2_000_000)]
    got = write_archives(pages(spark, rows).repartition(3)).read().filter("kind = 'record'").collect()
    assert len(got) == len(rows)
    by = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str)
    want = []
    for i, _, html in rows:
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        want.append((i, len((html or "").encode()), digest(html), "response" if i == top else "revisit", None if i == top else top))
    assert by == sorted(want, key=str)
    body = {r["page_id"]: bytes(r["block"]).decode() for r in got if r["record_type"] == "response"}
    assert body[5] == rows[-1][2] and body[9] == "<p>one</p>"
    assert write_archives(pages(spark, rows).limit(0)).read().count() == 0


def test_short_payloads_are_never_revisits(spark):
    rows = [(k, "u", "ab") for k in range(4)] + [(k, "u", "long payload") for k in range(4, 7)]
    got = write_archives(pages(spark, rows), least_bytes=5).read().collect()
    assert {r["page_id"] for r in got if r["record_type"] == "response"} == {0, 1, 2, 3, 6}


def test_salvage_finds_every_record_after_damage():
    rng = random.Random(2)
    raws = [record(k, "u", bytes(rng.randrange(256) for _ in range(rng.randrange(400))), None, False) for k in range(12)]
    parts = [member(r) if k % 3 else r for k, r in enumerate(raws)]
    whole = list(salvage(io.BytesIO(b"".join(parts))))
    assert [x.head["x-page-id"] for x in whole] == [str(k) for k in range(12)]
    for k in range(12):
        broken = list(parts)
        at = len(broken[k]) // 2
        broken[k] = broken[k][:at] + bytes([broken[k][at] ^ 0x55]) + broken[k][at + 1 :]
        found = list(salvage(io.BytesIO(b"junk" + b"".join(broken) + b"\x1f\x8b\x08tail")))
        ids = [int(x.head["x-page-id"]) for x in found if isinstance(x, Record)]
        assert set(range(12)) - {k} <= set(ids)
        gaps = [x for x in found if isinstance(x, Gap)]
        assert gaps[0] == Gap(0, 4) or gaps[0].offset == 0
        total = 4 + sum(map(len, broken)) + 7
        assert sum(g.n_bytes for g in gaps) + sum(len(parts[i]) for i in ids) == total
    cut = b"".join(parts)[:-3]
    assert [int(x.head["x-page-id"]) for x in salvage(io.BytesIO(cut)) if isinstance(x, Record)] == list(range(11))
    assert list(salvage(io.BytesIO(b""))) == []


def test_members_are_plain_gzip():
    raw = record(7, "http://x", b"abc", None, False)
    assert gzip.decompress(member(raw)) == raw and b"WARC-Type: response" in raw


class Counted(io.BytesIO):
    """A file that counts what is read."""

    n = 0

    def read(self, size=-1):
        got = super().read(size)
        self.n += len(got)
        return got


def plain_archive(n, size):
    rng = random.Random(1)
    return [record(k, "u", rng.randbytes(size), None, False) for k in range(n)]


def test_wrong_lengths_are_salvaged_in_linear_time():
    parts = plain_archive(1_000, 64_000)
    for wrong in (b"Content-Length: 99999999999", b"Content-Length: 20000000", b"Content-Length: 7", b"Content-Length: x", b"Content-Longth: 64000"):
        broken = [p.replace(b"Content-Length: 64000", wrong, 1) if k % 2 else p for k, p in enumerate(parts)]
        file = Counted(b"".join(broken))
        found = list(salvage(file))
        assert [int(x.head["x-page-id"]) for x in found if isinstance(x, Record)] == list(range(0, 1_000, 2))
        assert [x.n_bytes for x in found if isinstance(x, Gap)] == [len(p) for p in broken[1::2]]
        assert file.n < 3 * sum(map(len, broken))


def test_version_lines_without_heads():
    """A head that never ends isn't looked for beyond the next version line."""
    file = Counted(b"WARC/1.1\r\nA: b\r\n" * 100_000 + plain_archive(1, 10)[0])
    found = list(salvage(file))
    assert [type(x) for x in found] == [Gap, Record] and found[0].n_bytes == 1_600_000
    assert file.n < 3 * 1_600_000


def test_marks_across_pieces(monkeypatch):
    from symloom.llm import warc

    parts = plain_archive(30, 50)
    whole = b"".join(p if k % 2 else member(p) for k, p in enumerate(parts))
    want = [(x.offset, x.block) for x in salvage(io.BytesIO(whole))]
    for size in (64, 1_000):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        assert [(x.offset, x.block) for x in salvage(io.BytesIO(whole))] == want and len(want) == 30
        cut = b"junk" + whole[7:]
        assert sum(isinstance(x, Record) for x in salvage(io.BytesIO(cut))) == 29
