import base64
import hashlib

import pytest
import zstandard

from riskloom.llm import warc
from tests.llm.helpers import with_clashes

PAGE = "<html><head><title>Cuenta {0}</title></head><body><p>saldo de la cuenta {0} y movimientos</p></body></html>"


def pages(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3))


def test_records_come_back(spark, tmp_path):
    rows = [(i, f"http://banco.example/{i}?q=a b\r\nX: y", PAGE.format(i % 40)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (103, "u", "é" * 50_000), (104, "u", "é" * 50_000), (104, "u", "é" * 50_000), (None, "n", "é" * 50_000)]
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, rows), path)
    got = warc.read_archives(spark, path).collect()
    first = {}
    for key, _, html in rows:
        body = (html or "").encode()
        if key is not None:
            first[body] = min(key, first.get(body, key))
    expected = []
    for key, _, html in rows:
        body = (html or "").encode()
        kind = "response" if key == first[body] else "revisit"
        expected.append((str(key), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, str(None if kind == "response" else first[body])))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(expected)
    assert all(bytes(r.body) == (dict((k, h) for k, _, h in rows)[r.page_id] or "").encode() for r in got if r.record_type == "response")


def test_archives_are_of_bounded_size_and_complete_in_themselves(spark, tmp_path):
    path = str(tmp_path / "archives")
    rows = [(i, f"http://banco.example/{i}", PAGE.format(i * 7919)) for i in range(400)]
    warc.write_archives(pages(spark, rows), path, file_bytes=4000)
    files = [bytes(r.content) for r in warc.read_files(spark, path).collect()]
    assert len(files) > 6
    dictionary = {f[8:8 + int.from_bytes(f[4:8], "little")] for f in files}
    assert len(dictionary) == 1 and all(f[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little") for f in files)
    assert sorted(int(r["page_id"]) for f in files for r in warc.read_archive(f)) == list(range(400))
    assert all(len(f) < 8 + len(dictionary.copy().pop()) + 4000 + 2000 for f in files)


def test_small_bodies_are_all_responses(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), path, smallest_revisit=3)
    assert {r.page_id: r.refers_to for r in warc.read_archives(spark, path).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def archive(records, dictionary=b"", compressed=False):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    lead = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    return warc.skippable(lead) + b"".join(zstandard.ZstdCompressor(dict_data=held).compress(r) for r in records)


def test_a_dictionary_may_be_compressed_itself():
    bodies = [PAGE.format(i).encode() for i in range(300)]
    dictionary = zstandard.train_dictionary(4096, bodies).as_bytes()
    records = [warc.record(i, "u", b, warc.base32_sha1(b)) for i, b in enumerate(bodies)]
    for compressed in (False, True):
        found = list(warc.read_archive(archive(records, dictionary, compressed)))
        assert [f["body"] for f in found] == bodies


@pytest.mark.parametrize("damage", [
    lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), lambda r: r[:-1], lambda r: r.replace(b"cuenta", b"cuentb"),
    lambda r: r.replace(b"WARC/1.1", b"WORC/1.1"), lambda r: r.replace(b"WARC-Type: response\r\n", b""), lambda r: r.replace(b"WARC-Date: ", b"WARC Date; ")])
def test_damaged_records_are_refused(damage):
    body = PAGE.format(1).encode()
    with pytest.raises(ValueError):
        list(warc.read_archive(archive([damage(warc.record(1, "u", body, warc.base32_sha1(body)))])))


def test_damaged_frames_are_refused():
    body = PAGE.format(1).encode()
    good = archive([warc.record(1, "u", body, warc.base32_sha1(body))])
    for bad in (good[:-3], good + b"xx", good + b"0123456789", good[:4] + b"\xff\xff\xff\x00" + good[8:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(bad))
