import io
import random

import pytest

from tidemark.llm import warc
from tidemark.scratch import Scratch


def test_query_equals_sql(spark, small, duck, same_rows):
    assert same_rows(warc.op9_warc(spark, small).toPandas()) == same_rows(duck.execute(warc.OP9_SQL).df())


@pytest.mark.parametrize("split", [1, 50, 333, 10**6])
def test_every_record_once_in_any_split(split):
    r = random.Random(1)
    # Payloads that hold gzip magic and whole members, which must not be taken for records.
    inner = warc.record(1, "u", b"inner", None, False)
    payloads = [r.randbytes(r.randrange(400)) + warc.MAGIC * r.randrange(3) + inner * r.randrange(2) for _ in range(40)]
    data = b"".join(warc.record(i, f"http://x/{i}", p, None, False) for i, p in enumerate(payloads))
    got = [raw for a in range(0, len(data), split) for raw in warc.records(warc.Window(io.BytesIO(data), len(data)), a, min(len(data), a + split))]
    assert [warc.parse(x)[6] for x in got] == payloads


def test_cut_off_and_altered_records():
    data = warc.record(1, "u", b"payload" * 500, None, False)
    with pytest.raises(ValueError):
        list(warc.records(warc.Window(io.BytesIO(data), len(data) - 9), 0, len(data) - 9))
    with pytest.raises(ValueError):
        warc.parse(warc.member(warc.Window(io.BytesIO(data), len(data)), 0)[0].replace(b"payload", b"PAYLOAD"))


def test_odd_pages(spark):
    rows = [(1, "http://a b\n", "<p>Ä"), (2, None, "<p>Ä"), (2, None, "<p>Ä"), (None, "u", "<p>Ä"), (None, "u", None), (3, "u", ""), (4, "u", "z" * 700000), (5, "u", "ab"), (6, "u", "ab")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS keep", "2 AS response", "3 AS path")
    scratch = Scratch(spark, "test")

    def round_trip(frame, least):
        archives = scratch.table(warc.write_archives(frame, scratch.path("warc"), least))
        assert frame.isEmpty() or warc.read_archives(archives, 1000).rdd.getNumPartitions() >= 4
        return warc.read_archives(archives, 1000).collect()

    got = round_trip(pages, 0)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == sorted(
        [(1, "revisit", 2, 5), (2, "response", 0, 5), (2, "revisit", 2, 5), (0, "revisit", 2, 5), (0, "revisit", 3, 0), (3, "response", 0, 0), (4, "response", 0, 700000), (5, "revisit", 6, 2), (6, "response", 0, 2)]
    )
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {"<p>Ä", "", "z" * 700000, "ab"}
    assert {r.url for r in got if r.page_id == 1} == {"http://a%20b%0A"}
    assert [r.record_type for r in round_trip(pages, 3) if r.page_id in (5, 6)] == ["response"] * 2
    assert round_trip(pages.limit(0), 0) == []
