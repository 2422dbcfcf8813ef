import base64
import hashlib

import pytest

from pageframe.llm import warc
from pageframe.session import fresh_path

SCHEMA = "page_id long, url string, html string, payload string, first int"


def brute(rows, least):
    first = {}
    for i, _, html in rows:
        key = (html or "").encode()
        if i is not None:
            first[key] = min(first.get(key, i), i)
    out = []
    for i, _, html in rows:
        key = (html or "").encode()
        to = first.get(key) if len(key) >= least and first.get(key) not in (None, i) else None
        digest = base64.b32encode(hashlib.sha1(key).digest()).decode()
        out.append((i, len(key), digest, "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", f"<p>ü {i % 7}</p>\r\n\r\nWARC/1.1\r\n") for i in range(40)]
ROWS += [(90, None, None), (91, "u", ""), (-5, "a\r\nb: c", "x" * 300_000), (93, "u", "x" * 300_000), (None, "u", "<p>ü 1</p>"), (3, "u", ROWS[3][2]), (None, "u", "alone")]


@pytest.mark.parametrize("least,compress", [(0, True), (20, False)])
def test_round_trip(spark, least, compress):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.archived(pages, least, compress).collect()), key=str) == brute(ROWS, least)
    assert warc.archived(pages.limit(0)).collect() == []


def test_payloads_and_pushed_filters(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(2)
    for compress in (True, False):
        folder = fresh_path(spark, "warc")
        assert sum(r.records for r in warc.write_archives(pages, folder, compress=compress).collect()) == len(ROWS)
        read = warc.read_archives(spark, folder)
        some = read.where("record_type = 'response' AND target_uri = 'http://h/2'")
        assert [bytes(r.payload).decode() for r in some.collect()] == [ROWS[2][2]]
        assert read.where("record_type = 'revisit'").count() == sum(r[3] == "revisit" for r in brute(ROWS, 0))
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "record_type" in plan


def test_digests_are_those_of_the_stored_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "good page"), (2, "u", "good page"), (3, "u", "other")], "page_id long, url string, html string").coalesce(1)
    folder = fresh_path(spark, "warc")
    files = warc.write_archives(pages, folder, compress=False)
    before = {r.page_id: r for r in warc.read_back(spark, folder, files.select("file")).collect()}
    system, root = warc.located(folder)
    for row in files.collect():
        with system.open_input_file(f"{root}/{row.file}") as stream:
            data = stream.read()
        with system.open_output_stream(f"{root}/{row.file}") as stream:
            stream.write(data.replace(b"good page", b"goad page"))
    found = warc.read_back(spark, folder, files.select("file"))
    after = {r.page_id: r for r in found.collect()}
    assert after[1].payload_digest == base64.b32encode(hashlib.sha1(b"goad page").digest()).decode() != before[1].payload_digest
    assert after[2].payload_digest == before[1].payload_digest and after[3] == before[3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "= response)" not in plan and "= revisit)" not in plan  # pushed into the scans, not filtered after them


def test_unwanted_records_are_not_taken():
    import io

    data = b"".join(warc.record(i, "u", b"q" * 100_000, "D", 0 if i else None, False) for i in range(5))

    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.got += len(out)
            return out

    data += b"".join(warc.record(i, "v", b"q" * 1_000_000, "D", None, False) for i in range(9, 12))
    found = list(warc.records(Counting(data), False, [("record_type", "revisit")], True, "f"))
    assert [r[1] for r in found] == [f"<urn:x-page:{i}>" for i in range(1, 5)]
    assert Counting.got < 1_000_000
