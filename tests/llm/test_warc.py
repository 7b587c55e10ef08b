"""The WARC writer and reader: exact round trip, revisits, files, odd rows."""

import base64
import gzip
import hashlib
import json
from pathlib import Path

from kinstats.llm.warc import read_warc, write_warc


def expected(rows, min_bytes=0):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, url, h in rows:
        data = (h or "").encode()
        first = least.get(h or "") if len(data) >= min_bytes else None
        again = first is not None and first != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}.org/{k}", f"<p>{k % 7}</p>" * (1 + 400 * (k % 5))) for k in range(60)]
    rows += [(100, None, None), (101, "", ""), (101, "", ""), (102, "a b\r\nc", None), (None, "x", "<p>1</p>"), (None, "x", "only"), (7, "other", "<p>1</p>"), (103, "é", "ü" * 70_000)]
    frame = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, sha string").repartition(3)
    for name, shard, roll, least in (("a", 1 << 24, 1 << 24, 0), ("b", 90_000, 1500, 0), ("c", 20_000, 1 << 24, 10)):
        folder = write_warc(frame, str(tmp_path / name), shard_bytes=shard, roll_bytes=roll, min_bytes=least)
        got = read_warc(spark, folder).collect()
        assert sorted([(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got], key=str) == expected(rows, least)
    files = sorted(Path(tmp_path / "b").glob("*.warc.gz"))
    told = json.loads(Path(tmp_path / "b" / "MANIFEST.json").read_text())["files"]
    assert len(files) > 3 and [f.name for f in files] == [x["file"] for x in told] and [f.stat().st_size for f in files] == [x["bytes"] for x in told]
    assert sum(x["records"] for x in told) == len(rows)
    assert all(gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in files)
    # However the rows came, the same files come out.
    assert [x["sha1"] for x in told] == [hashlib.sha1(f.read_bytes()).hexdigest() for f in files]
    again = write_warc(frame.repartition(1), str(tmp_path / "d"), shard_bytes=90_000, roll_bytes=1500)
    assert [Path(again, f.name).read_bytes() for f in files] == [f.read_bytes() for f in files]


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    folder = write_warc(frame, str(tmp_path / "e"))
    assert read_warc(spark, folder).count() == 0


def test_equal_rows_fill_several_shards(spark, tmp_path):
    rows = [(None, None, "<p>" + "x" * 2000)] * 60 + [(5, "u", "<p>" + "x" * 2000)] * 40 + [(6, f"u{k}", "<p>" + "x" * 2000) for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = write_warc(frame, str(tmp_path / "f"), shard_bytes=20_000)
    got = read_warc(spark, folder).collect()
    assert sorted([(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got], key=str) == expected(rows)
    told = json.loads((tmp_path / "f" / "MANIFEST.json").read_text())["files"]
    assert len(told) > 10 and max(x["records"] for x in told) < 30
