import base64
import hashlib
import random
from collections import defaultdict

import pytest
import zstandard

from spanforge.llm import warc


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, (page_id, html) in enumerate(rows):
        groups[(html or "").encode()].append((page_id is not None, page_id or 0, i))
    out = []
    for payload, members in groups.items():
        top = max(members)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for m in members:
            page_id = m[1] if m[0] else None
            response = m == top or len(payload) < least
            out.append((page_id, len(payload), digest, "response" if response else "revisit", None if response or not top[0] else top[1]))
    return sorted(out, key=repr)


def pages(n=300, seed=4):
    rng = random.Random(seed)
    words = ["<p>", "</p>", "<a href='x'>", "étude", "page", "中文", "\r\n\r\n", "the", "of", "\x00", "😀", "WARC/1.1\r\n"]
    rows = [(i, f"http://h{i % 7}.example/{i}?q=a b\r\nX: y", " ".join(rng.choice(words) for _ in range(rng.randint(5, 300)))) for i in range(n)]
    same = rows[3][2]
    rows += [(1000 + i, f"http://copy/{i}", same) for i in range(40)]
    rows += [(2000, None, None), (2001, "http://e", ""), (2002, "u", None), (None, "u", same), (None, None, "no id"), (None, None, "no id"), (7, "again", same), (7, "again", same), (3000, "long", "x y" * 700_000), (1039, "http://copy/39", same)]
    rng.shuffle(rows)
    return [(*r, 1, "d", 2) for r in rows]


SCHEMA = "page_id long, url string, html string, row long, digest string, n int"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pages(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("least", [0, 20])
def test_report_against_brute_force(table, least):
    got = warc.revisit_report(table, least=least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(r[0], r[2]) for r in pages()], least)


def test_small_archives_resolve_to_all_pages(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "TRAIN_BYTES", 30_000)
    written = warc.write(table)
    assert written.count() > 5 and written.select("archive").distinct().count() == written.count()
    saved = warc.save(written, str(tmp_path))
    assert saved.count() == written.count()
    back = warc.read(warc.load(spark, str(tmp_path)), strict=True).cache()
    assert back.where("record_type = 'warcinfo'").count() == written.count()
    assert back.select("record_id").distinct().count() == back.count()
    whole = warc.resolved(back)
    want = sorted(((r[0], (r[2] or "").encode()) for r in pages()), key=repr)
    assert sorted(((r.id and int(r.id), bytes(r.payload)) for r in whole.collect()), key=repr) == want
    urls = {r.url for r in back.collect() if r.url and r.url.startswith("http://h")}
    assert all("%0D%0AX:%20y" in u for u in urls)


def archive(payloads, **kind):
    writer = warc.Writer(payloads * kind.get("times", 1))
    frames = [writer.frame(warc.page_record("t", i, str(i), "u", p, None)) for i, p in enumerate(payloads)]
    return writer, frames


def test_dictionary_is_used_and_may_be_plain_or_absent():
    payloads = [f"<html><body class='main-page'><h1>Title {i}</h1> some text about number {i * 7919} and more of it</body></html>".encode() * 3 for i in range(200)]
    writer, frames = archive(payloads)
    assert writer.dictionary is not None and zstandard.get_frame_parameters(frames[0]).dict_id == writer.dictionary.dict_id() != 0
    assert sum(map(len, frames)) < sum(len(zstandard.compress(warc.page_record("t", i, str(i), "u", p, None))) for i, p in enumerate(payloads))
    for front in (writer.front, warc.skippable(writer.dictionary.as_bytes())):
        assert [r["payload"] for r in warc.records(front + b"".join(frames), strict=True)] == payloads
    few, alone = archive([b"a"])
    assert few.front == b"" and [r["payload"] for r in warc.records(b"".join(alone), strict=True)] == [b"a"]
    missing = [*warc.records(b"".join(frames))]
    assert len(missing) == 200 and all("dictionary" in r["error"] for r in missing)
    # frames in between that hold no records are passed over, and frames may leave their size out
    stream = zstandard.ZstdCompressor(dict_data=writer.dictionary, write_content_size=False).compressobj()
    unsized = stream.compress(warc.page_record("t", 9, "9", "u", b"late", None)) + stream.flush()
    got = [*warc.records(writer.front + frames[0] + warc.skippable(b"note", 0x184D2A51) + frames[1] + unsized, strict=True)]
    assert [r["payload"] for r in got] == [*payloads[:2], b"late"]


def test_frames_are_found_by_their_sizes():
    rng = random.Random(1)
    contents = [b"", b"z" * 500_000, rng.randbytes(300_000), rng.randbytes(200_000) + b"0" * 200_000]
    for checksum in (True, False):
        parts = [zstandard.ZstdCompressor(write_checksum=checksum).compress(c) for c in contents]
        assert [bytes(f) for _, f in warc.frames(b"".join(parts))] == parts


@pytest.mark.parametrize(("change", "error"), [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9", 1), "version"),
    (lambda r: r.replace(b"WARC-Type: response\r\n", b"", 1), "no WARC-Type"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Data", 1), "no WARC-Date"),
    (lambda r: r.replace(b"payload text", b"payload TEXT", 1), "block digest"),
    (lambda r: r + b"x", "Content-Length"),
    (lambda r: r[:-6], "Content-Length"),
    (lambda r: r.replace(b"Content-Length: ", b"Content-Length: -", 1), "Content-Length"),
    (lambda r: r.replace(b"\r\nWARC-Payload-Digest: sha1:", b"\r\nWARC-Payload-Digest: sha1:A", 1), "payload digest"),
    (lambda r: r.replace(b"\r\nContent-Type: app", b"\r\nContent Type app", 1), "without a name"),
])
def test_a_record_that_is_wrong_is_told_and_the_others_are_read(change, error):
    good = warc.page_record("t", 1, "1", "u", b"some payload text", None)
    bad = change(good)
    assert bad != good
    frames = [zstandard.compress(x) for x in (good, bad, good)]
    got = [*warc.records(b"".join(frames))]
    assert [r["error"] is None for r in got] == [True, False, True] and error in got[1]["error"]
    with pytest.raises(warc.Malformed):
        [*warc.records(b"".join(frames), strict=True)]


def test_cut_off_and_broken_frames(monkeypatch):
    good = zstandard.ZstdCompressor(write_checksum=True).compress(warc.page_record("t", 1, "1", "u", b"some payload text" * 50, None))
    for cut in (1, 7, 20, len(good) - 1):
        got = [*warc.records(good + good[:cut])]
        assert len(got) == 2 and got[0]["error"] is None and "cut-off" in got[1]["error"]
    broken = good[:-1] + bytes([good[-1] ^ 1])
    assert ["undecodable" in (r["error"] or "") for r in warc.records(broken + good)] == [True, False]
    assert ["no frame" in (r["error"] or "") for r in warc.records(good + b"plain text, no frame")] == [False, True]
    monkeypatch.setattr(warc, "RECORD_BYTES", 100)
    assert "limit" in next(warc.records(good))["error"]
    assert "no dictionary" in next(warc.records(warc.skippable(b"abc")))["error"]


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.write(none).count() == 0 and warc.revisit_report(none).count() == 0
    text_ids = spark.createDataFrame([("a b:\r\n", "u", "t"), ("z%41", "u", "t")], "page_id string, url string, html string")
    assert sorted((r.page_id, r.refers_to) for r in warc.revisit_report(text_ids).collect()) == [("a b:\r\n", "z%41"), ("z%41", None)]
