"""Upserts into a stored table, live overrides, steps carried out with a journal."""

import threading

import pytest
from pyspark.sql import functions as F

from framewise.operators import carry
from framewise.sources import files, store
from framewise.streaming import overrides

SCHEMA = "name string, label string, logo string"


def table(spark, tmp_path, n_buckets=8):
    return store.Store(spark, f"file://{tmp_path}/features", SCHEMA, ["name"], n_buckets)


def rows(spark, *given):
    return spark.createDataFrame(list(given), "name string, label string, logo string, pos int")


def held(t, version=None):
    return {r["name"]: (r["label"], r["logo"]) for r in t.read(version).collect()}


def test_upserts_replace_whole_records(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.manifest()["version"] == 0
    assert t.upsert(rows(spark, ("a", "ad", "Fox", 1), ("b", "ad", "NBC", 2), (None, "ad", "x", 3))) == 1
    # The last of a key counts, its nulls too.
    assert t.upsert(rows(spark, ("a", "content", "Fox", 1), ("a", None, "USA", 2), ("c", "ignore", None, 1)), by="pos") == 2
    assert held(t) == {"a": (None, "USA"), "b": ("ad", "NBC"), "c": ("ignore", None)}
    assert held(t, 1) == {"a": ("ad", "Fox"), "b": ("ad", "NBC")}
    assert t.upsert(rows(spark).filter("false")) == 2
    assert t.remove(spark.createDataFrame([("b",), ("z",)], "name string")) == 3 and set(held(t)) == {"a", "c"}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path, 16)
    t.upsert(spark.range(200).select(F.col("id").cast("string").alias("name"), F.lit("ad").alias("label"), F.lit(None).cast("string").alias("logo")))
    before = t.manifest()["buckets"]
    t.upsert(rows(spark, ("7", "content", None, 1)))
    after = t.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 16
    assert held(t)["7"] == ("content", None) and len(held(t)) == 200


def test_a_writer_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("a", "ad", None, 1)))
    with monkeypatch.context() as m:
        # It dies behind its claim, with its data written.
        real = store.Store._commit

        def dying(self, manifest):
            m.setattr(store.json, "dumps", lambda *a: (_ for _ in ()).throw(KeyError("killed")))
            real(self, manifest)

        m.setattr(store.Store, "_commit", dying)
        with pytest.raises(KeyError):
            t.upsert(rows(spark, ("a", "content", None, 1)))
    assert held(t) == {"a": ("ad", None)} and len(t.unused()) == 1
    assert t.upsert(rows(spark, ("b", "ad", None, 1))) == 3  # its number is passed over
    assert held(t) == {"a": ("ad", None), "b": ("ad", None)}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    found = []

    def write(i):
        try:
            table(spark, tmp_path, 1).upsert(rows(spark, (f"k{i}", "ad", None, 1)))
        except Exception as e:  # noqa: BLE001
            found.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not found and set(held(table(spark, tmp_path))) == {f"k{i}" for i in range(4)}


def test_a_writer_that_is_overtaken_behind_its_check_starts_over(spark, tmp_path, monkeypatch):
    slow, fast = table(spark, tmp_path, 1), table(spark, tmp_path, 1)
    real, made = store.json.dumps, []

    def dumps(x, **kw):
        # The slow writer has claimed its number and seen that its base is the latest.
        if "base" in x:
            monkeypatch.setattr(store.json, "dumps", real)
            made.append(fast.upsert(rows(spark, ("b", "ad", None, 1))))
        return real(x, **kw)

    monkeypatch.setattr(store.json, "dumps", dumps)
    made.append(slow.upsert(rows(spark, ("a", "ad", None, 1))))
    assert set(held(table(spark, tmp_path))) == {"a", "b"} and made[0] < made[1]
    assert slow.versions() == made and set(held(slow, made[0])) == {"b"}


def test_a_version_counts_though_its_writer_died_before_naming_it(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, 1)
    with monkeypatch.context() as m:
        real = store.Store._renamed
        m.setattr(store.Store, "_renamed", lambda self, old, new: real(self, old, new) if not old.startswith("manifest/") else False)
        assert t.upsert(rows(spark, ("a", "ad", None, 1))) == 1
    assert set(held(t)) == {"a"} and t.versions() == [1]
    assert t.upsert(rows(spark, ("b", "ad", None, 1))) == 2 and set(held(t)) == {"a", "b"} and set(held(t, 1)) == {"a"}


def test_overrides_count_from_the_next_batch(spark, tmp_path):
    home, out = f"file://{tmp_path}/overrides", f"file://{tmp_path}/out"
    put = lambda *r: overrides.store(spark, home).upsert(spark.createDataFrame(list(r), "pos long, phash long, label string"))
    frames = spark.createDataFrame([("x", 0b1011), ("y", -1)], "name string, phash long")
    sink = overrides.sink(home, out, threshold=2)
    told = lambda b: dict(spark.read.parquet(f"{out}/batch={b}").select("name", "label").collect())
    sink(frames, 0)
    put((1, 0b0011, "content"))
    sink(frames, 1)
    sink(frames, 2)
    put((0, 0b1111, "ad"))  # earlier in order of insertion
    sink(frames, 3)
    assert [told(b) for b in range(4)] == [{"x": None, "y": None}, {"x": "content", "y": None}, {"x": "content", "y": None}, {"x": "ad", "y": None}]


def test_steps_are_carried_out_once_and_can_be_repeated(spark, tmp_path, monkeypatch):
    root = tmp_path / "frames"
    root.mkdir()
    for i in range(40):
        (root / f"{i}.png").write_text(str(i))
    (root / "images").mkdir()
    (root / "images/3.png").write_text("old")
    steps = [(f"{i}.png", f"images/{i}.png" if i % 4 else None) for i in range(40)] + [("gone.png", "images/gone.png"), ("5.png", "images/5.png"), (None, "x")]
    plan = spark.createDataFrame(steps, "src string, dest string")
    log = f"file://{tmp_path}/journal"
    dry = carry.carried(plan, root.as_uri(), log).collect()
    assert len(dry) == 41 and {r["outcome"] for r in dry} == {"would move", "would delete"} and len(list(root.glob("*.png"))) == 40
    # Killed midway: tasks did some steps, and no journal was written.
    files, base = carry.fs.FileSystem.from_uri(root.as_uri())
    for i in (1, 4, 6, 8):
        carry.step(files, f"{base}/{i}.png", f"{base}/images/{i}.png" if i % 4 else None)
    for _ in range(2):
        got = {r["src"]: r["outcome"] for r in carry.carried(plan, root.as_uri(), log, apply=True).collect()}
        want = {s: "skipped" if s == "3.png" else "missing" if s == "gone.png" else "moved" if d else "deleted" for s, d in steps if s}
        assert got == want
    assert [p.name for p in root.glob("*.png")] == ["3.png"] and (root / "images/3.png").read_text() == "old"
    assert sorted(int(p.stem) for p in (root / "images").glob("*.png")) == [i for i in range(40) if i % 4]
    assert (root / "images/5.png").read_text() == "5"


def test_contents_are_read_by_the_rows_that_name_them(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for i in range(600):
        (tmp_path / f"a/{i}.bin").write_bytes(b"\x00" * (i % 3))
    rows = spark.createDataFrame([(f"a/{i}.bin",) for i in range(600)] + [("a/none.bin",), (None,)], "at string").coalesce(1)
    got = files.contents_at(rows, tmp_path.as_uri(), "at")
    # A folder of millions of files is not listed by the driver, and few bytes of paths are many tasks.
    assert not got.inputFiles() and got.rdd.getNumPartitions() == 4
    assert {r["at"]: None if r["content"] is None else len(r["content"]) for r in got.collect()} == {f"a/{i}.bin": i % 3 for i in range(600)} | {"a/none.bin": None, None: None}


def test_steps_make_a_folder_once():
    made, done = [], []

    class Files:
        create_dir = lambda self, path, recursive: made.append(path)
        move = lambda self, src, dest: done.append(dest)

        def get_file_info(self, path):
            return carry.fs.FileInfo(path, carry.fs.FileType.NotFound if path.startswith("/to/") else carry.fs.FileType.File)

    known = set()
    assert [carry.step(Files(), f"/from/{i}", f"/to/{i % 2}/{i}", known) for i in range(6)] == ["moved"] * 6
    assert made == ["/to/0", "/to/1"] and len(done) == 6
