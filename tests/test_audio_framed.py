"""The audio ring against a list of chunks, WAV files against the library, framed messages cut at random."""

import io
import random
import struct
import wave

from pyspark.sql import functions as F

from framewise.operators import audio
from framewise.sources import framed


def plain_ring(events, rate, keep_s):
    """Slices as a queue of chunks gives them: events (ts, pcm or ms)."""
    most, chunks, out = int(keep_s * rate), [], []
    for _, e in sorted(events, key=lambda e: (e[0], isinstance(e[1], int))):
        if isinstance(e, int):
            want = e * rate // 1000
            held = b"".join(chunks)
            out.append((b"\0\0" * want if not held else held[len(held) - min(2 * want, len(held)) :]))
        elif e:
            chunks.append(e)
            while sum(map(len, chunks)) // 2 > most:
                chunks.pop(0)
    return out


def test_slices_match_a_queue_of_chunks(spark):
    rng = random.Random(4)
    for trial in range(3):
        events = [(t, rng.randbytes(2 * rng.choice([0, 1, 3, 7, 25, 60])) if rng.random() < 0.7 else rng.choice([0, 1, 5, 20, 49, 80])) for t in range(60)]
        chunks = [(1, t, t, e) for t, e in events if not isinstance(e, int)] + [(2, 0, 0, None)]
        asks = [(1, t, t, e) for t, e in events if isinstance(e, int)] + [(2, 5, 5, 10), (3, 1, 1, 10)]
        out = audio.slices(spark.createDataFrame(chunks, "key long, ts long, seq long, pcm binary"), spark.createDataFrame(asks, "key long, ts long, seq long, ms long"), 1000, 1, 0.05).collect()
        got = {(r["key"], r["seq"]): bytes(r["wav"])[44:] for r in out}
        assert len(out) == len(asks) and got[2, 5] == got[3, 1] == bytes(20)
        assert [got[1, t] for t, e in events if isinstance(e, int)] == plain_ring(events, 1000, 0.05)


def test_wav_header(spark):
    pcm = random.Random(1).randbytes(4 * 300)
    got = bytes(spark.createDataFrame([(bytearray(pcm),)], "pcm binary").select(audio.wav(F.col("pcm"), 48_000, 2)).first()[0])
    with wave.open(io.BytesIO(got)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(10_000)) == (2, 2, 48_000, pcm)


def cut(data, rng, mean):
    at = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(len(data) // mean))})
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def read(spark, streams):
    rows = [(s, i, bytearray(p) if p is not None else None) for s, parts in streams.items() for i, p in enumerate(parts)]
    return framed.messages(spark.createDataFrame(rows, "stream string, part long, data binary").repartition(4)).collect()


def test_a_hundred_thousand_messages_cut_at_random_places(spark):
    rng = random.Random(9)
    payloads = [rng.randbytes(rng.choice([0, 1, 2, 10, 40])) for _ in range(100_000)]
    payloads[5000] = rng.randbytes(200_000)  # longer than many parts
    data = b"".join(struct.pack("<I", len(p)) + p for p in payloads)
    rows = read(spark, {"a": cut(data, rng, 40_000)})
    assert all(r["complete"] for r in rows)
    assert [bytes(r["payload"]) for r in sorted(rows, key=lambda r: r["at"])] == payloads


def test_streams_that_break_off_and_tiny_parts(spark):
    rng = random.Random(2)
    say = lambda *ps: b"".join(struct.pack("<I", len(p)) + p for p in ps)
    one = say(b"{}", b"", b"hello")
    rows = read(spark, {
        "bytes": [one[i : i + 1] for i in range(len(one))],
        "short": [one + struct.pack("<I", 9) + b"abc"],
        "head": [b"", None, one, b"\1\0"],
        "noise": [one, struct.pack("<I", 2**31) + b"xyz", one],
        "empty": [None],
    })
    got = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        got.setdefault(r["stream"], []).append((bytes(r["payload"]), r["complete"]))
    whole = [(b"{}", True), (b"", True), (b"hello", True)]
    assert got == {"bytes": whole, "short": [*whole, (b"abc", False)], "head": whole, "noise": [*whole, (b"", False)]}
    assert rng


def test_work_follows_bytes_not_cuts(spark, monkeypatch):
    """Thousands of short parts become a few, of which none starts outside its bytes; messages over their borders stay whole."""
    monkeypatch.setattr(framed, "CHUNK", 1000)
    rng = random.Random(4)
    payloads = [rng.randbytes(rng.choice([0, 3, 30, 300, 2500])) for _ in range(60)]
    data = b"".join(struct.pack("<I", len(p)) + p for p in payloads)
    parts = cut(data, rng, 5)
    rows = [("a", i, bytearray(p)) for i, p in enumerate(parts)]
    some = framed.chunked(framed.placed(spark.createDataFrame(rows, "stream string, part long, data binary"))).orderBy("start").collect()
    assert len(some) <= len(data) // 1000 + 1 < len(parts) // 50
    assert b"".join(bytes(r["data"]) for r in some) == data
    assert all(r["end"] - r["start"] == len(r["data"]) and bytes(r["more"]) == data[r["end"] : r["end"] + 3] for r in some)
    got = read(spark, {"a": parts})
    assert all(r["complete"] for r in got) and [bytes(r["payload"]) for r in sorted(got, key=lambda r: r["at"])] == payloads
