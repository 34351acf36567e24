"""Headers of the archive that look like others, or no longer fit their payload."""

import hashlib

import pytest
from pyspark.errors import PythonException, SparkRuntimeException

from lawspark.llm import warc

URL = "http://x.y/?q=WARC-Type: response\r\nWARC-Type: response\r\n"


@pytest.fixture
def archive(spark):
    rows = [(1, URL, "same"), (2, URL, "same"), (3, None, "other"), (4, URL, None)]
    return warc.store(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_url_that_holds_header_text(spark, archive):
    got = {r.page_id: bytes(r.record) for r in warc.records(spark, archive).collect()}
    for page, payload in ((1, b""), (2, b"same"), (3, b"other"), (4, b"")):
        head, _, rest = got[page].partition(b"\r\n\r\n")
        assert rest == payload + b"\r\n\r\n"
        assert int(warc.parse_header(head + b"\r\n\r\n")["Content-Length"]) == len(payload)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc.index(spark, archive).collect()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None)}


def test_header_that_does_not_fit_is_an_error(spark, archive, tmp_path):
    head = spark.read.parquet(f"{archive}/heads").collect()
    wrong = [(r.page_id, r.digest, bytes(r.head).replace(b"Content-Length: 5", b"Content-Length: 6")) for r in head]
    place = str(tmp_path / "archive")
    spark.createDataFrame(wrong, "page_id long, digest string, head binary").write.parquet(f"{place}/heads")
    spark.read.parquet(f"{archive}/payloads").write.parquet(f"{place}/payloads")
    with pytest.raises((SparkRuntimeException, PythonException), match=hashlib.sha256(b"other").hexdigest()):
        warc.index(spark, place).collect()
