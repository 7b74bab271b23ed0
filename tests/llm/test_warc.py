"""Archives against the definition of the records, on odd rows and whole tables."""

import gzip
import io

import pytest

from seqstates.llm import warc
from seqstates.llm.common import table


def wanted(rows):
    last = {}
    for r in rows:
        payload = (r.html or "").encode()
        if r.page_id is not None:
            last[payload] = max(last.get(payload, r.page_id), r.page_id)
    out = []
    for r in rows:
        payload = (r.html or "").encode()
        refers = last.get(payload)
        refers = None if refers == r.page_id else refers
        out.append((r.page_id, len(payload), warc.payload_digest(payload), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("odd", [False, True])
def test_round_trip(spark, sf_dir, odd, monkeypatch):
    pages = table(spark, sf_dir, "pages")
    if odd:
        monkeypatch.setattr(warc, "MAX_FILE_BYTES", 1000)
        rows = [(1, "http://a", "x" * 50), (2, "b\r\nc d", "x" * 50), (2, None, "x" * 50), (3, "u", None), (4, "u", ""), (None, "n", "x" * 50)]
        rows += [(None, "n", "alone"), (5, "é", "\r\n\r\nWARC/1.0\r\n" * 20000), (6, "z", "日本" * 3000)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("last", warc.F.lit("clash"))
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    assert got == wanted(pages.collect())


def test_empty(spark, sf_dir):
    assert warc.round_trip(table(spark, sf_dir, "pages").limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_members_stand_alone(block, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", block)
    records = [warc.record(i, f"u{i}", b"payload %d" % i * i, None if i % 3 else 9) for i in range(20)]
    for source in (gzip.compress(b"".join(records)), gzip.compress(b"".join(records[:5])) + gzip.compress(b"".join(records[5:]))):
        sink = io.BytesIO()
        places = [(offset, size) for offset, size, _ in warc.split_members(io.BytesIO(source), sink)]
        data = sink.getvalue()
        assert [gzip.decompress(data[o : o + n]) for o, n in places] == records
        assert gzip.decompress(data) == b"".join(records)


def test_cut_archives_are_refused():
    with pytest.raises((ValueError, EOFError)):
        list(warc.split_members(io.BytesIO(gzip.compress(warc.record(1, "u", b"x" * 100, None)[:-30])), io.BytesIO()))
