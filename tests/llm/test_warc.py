import base64
import hashlib

import pytest
import zstandard

from tidewatch.llm.warc import DICTIONARY_MAGIC, frames_of, parsed, read_archives, record, write_archives


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def rows_of(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string, frame string")
    path = str(tmp_path / "warc")
    write_archives(pages, path, **options)
    return path, read_archives(spark, path).collect()


PAGES = [(1, "http://a/ b\r\nX: y", "<p>é\U0001F600</p>"), (2, None, None), (3, "u", ""), (4, "v", "same"), (9, "w", "same"),
         (6, "x", "same"), (7, "y", "P*M\x18\0\0\0\0 \r\n\r\n WARC/1.1"), (8, "z", "long " * 60_000), (8, "z", "long " * 60_000)]


def test_round_trip(spark, tmp_path):
    path, got = rows_of(spark, tmp_path, [(*p, "c", "c", "c") for p in PAGES])
    assert len(got) == len(PAGES) and all(r["error"] is None for r in got)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        body = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), sha(body))
        assert r["payload"] == (bytes(body) if r["record_type"] == "response" else None)
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2: 3, 4: 9, 6: 9}


def test_small_payloads_are_responses(spark, tmp_path):
    _, got = rows_of(spark, tmp_path, [(*p, "c", "c", "c") for p in PAGES], min_bytes=5)
    assert all(r["record_type"] == "response" for r in got)


def test_empty_table(spark, tmp_path):
    assert rows_of(spark, tmp_path, [])[1] == []


def test_dictionary_leads_and_each_record_has_a_frame(spark, tmp_path):
    path, got = rows_of(spark, tmp_path, [(i, "u", f"<html><body>page {i} of many</body></html>" * 20, "", "", "") for i in range(200)])
    files = spark.read.format("binaryFile").load(path).collect()
    records = 0
    for f in files:
        frames = list(frames_of(memoryview(bytes(f["content"]))))
        assert frames[0][0] == DICTIONARY_MAGIC and len(frames[0][1]) > 100
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frames[0][1])))
        for magic, body in frames[1:]:
            if not magic:
                parsed(press.decompress(body))
                records += 1
    assert records == len(got) == 200


@pytest.mark.parametrize("old, new, said", [
    (b"WARC/1.1", b"WARD/1.1", "no WARC header"), (b"WARC-Date", b"WARC-Dote", "no WARC-Date"), (b"hello", b"hell", "Content-Length"),
    (b"hello", b"jello", "digest"), (b"Content-Length: 5\r\n", b"Content-Length: 4\r\n", "HTTP length"), (b"urn:page", b"urn:pug!", "record id")])
def test_checks(old, new, said):
    raw = record(1, "u", b"hello", sha(b"hello"), False, None)
    assert parsed(raw)["payload"] == b"hello"
    with pytest.raises(ValueError, match=said):
        parsed(raw.replace(old, new, 1))


def test_damaged_archives_say_so(spark, tmp_path):
    good = zstandard.compress(record(1, "u", b"hello", sha(b"hello"), False, None))
    bad = zstandard.compress(record(2, "u", b"hello", sha(b"jello"), False, None))
    (tmp_path / "a.warc.zst").write_bytes(good + bad + good)
    (tmp_path / "b.warc.zst").write_bytes(good + good[:-3])
    (tmp_path / "c.warc.zst").write_bytes(good + b"what is this")
    got = read_archives(spark, str(tmp_path)).collect()
    by = {n: [r["error"] is None for r in got if r["archive"].endswith(f"{n}.warc.zst")] for n in "abc"}
    assert by == {"a": [True, False, True], "b": [True, False], "c": [True, False]}
