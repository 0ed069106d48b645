"""The request source: offsets, splits, replay, lines that are none; and what requests become."""

import json
import random

from framewise.streaming import requests


def line(n, route="/receive", image=True, **form):
    return json.dumps({"client": n % 3, "at": f"2026-01-01T10:00:{n % 60:02}", "n": n, "route": route, "form": form, "image": image}) + "\n"


def taken(reader, start, end):
    return [row for part in reader.partitions(start, end) for row in reader.read(part)]


def test_ranges_hold_every_line_once(tmp_path):
    rng = random.Random(3)
    lines = [line(i, note="é" * rng.randint(0, 300)) if i % 7 else "\n" if i % 2 else "no request\n" for i in range(500)]
    data = "".join(lines).encode()
    (tmp_path / "a.jsonl").write_bytes(data + b'{"client": 9')
    (tmp_path / "b.jsonl").write_bytes(lines[1].encode())
    (tmp_path / "c.txt").write_bytes(b"x\n")
    for split in (1, 50, 7777, 1 << 20):
        reader = requests.Reader({"path": tmp_path.as_uri(), "split": str(split)})
        end = reader.latestOffset()
        assert end == {"a.jsonl": len(data), "b.jsonl": len(lines[1].encode())}
        rows = [r for r in taken(reader, reader.initialOffset(), end) if r[0] == "a.jsonl"]
        assert [r[4] for r in rows if not r[-1]] == [i for i in range(500) if i % 7]
        assert sum(r[-1] for r in rows) == sum(x == "no request\n" for x in lines)
        assert [data[r[1] :].split(b"\n", 1)[0] for r in rows] == [x.strip().encode() for x in lines if x.strip()]
    # The half line waits until it is whole, and a range that is read again gives the same rows.
    with open(tmp_path / "a.jsonl", "ab") as f:
        f.write(b', "at": "x", "n": 7, "route": "/capture"}\n' + line(8).encode())
    new = reader.latestOffset()
    assert [(r[2], r[4]) for r in taken(reader, end, new)] == [(9, 7), (2, 8)]
    assert taken(reader, end, new) == taken(reader, end, new) and taken(reader, new, new) == []
    assert requests.Reader({"path": (tmp_path / "none").as_uri()}).latestOffset() == {}


def test_branches_of_requests(spark):
    cases = [
        ("/receive", True, {}, "frame"), ("/receive", False, {"is_seeking": "True", "is_paused": "1"}, "seeking"), ("/receive", False, {"is_paused": "YES"}, "paused"),
        ("/receive", False, {"is_paused": "no"}, "reject"), ("/video-state", False, {"is_seeking": "1", "is_paused": "1"}, "paused"), ("/video-state", False, {}, "resumed"),
        ("/report_wrong", False, {"result": "ad"}, "report"), ("/pause_auto_switch", False, {}, "pause"), ("/nowhere", False, {}, "reject"),
    ]
    rows = [("f", i, 1, "2026-01-01 10:00:00", i, r, f, image, False) for i, (r, image, f, _) in enumerate(cases)] + [("f", 99, None, None, None, None, None, None, True)]
    df = spark.createDataFrame(rows, requests.SCHEMA)
    got = {r["at"]: r["kind"] for r in df.withColumn("kind", requests.branch()).collect()}
    assert [got[i] for i in range(len(cases))] == [k for *_, k in cases] and got[99] == "reject"
    assert sorted(r["seq"] for r in requests.log_rows(df).collect()) == [0, 6, 7]


def test_a_growing_journal_is_streamed(spark, tmp_path):
    def run():
        query = requests.read_requests(spark, (tmp_path / "in").as_uri(), 100).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("".join(map(line, range(20))))
    assert run() == list(range(20))
    with open(tmp_path / "in/a.jsonl", "a") as f:
        f.write("".join(map(line, range(20, 30))))
    (tmp_path / "in/b.jsonl").write_text(line(30))
    assert run() == list(range(31)) == run()
