"""Registered queries over files and pixels: each writes a small log or made images to the shared folder, reads them back, and has a SQL twin."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framewise.functions import checks, encode, pixels, profiles, replies, shapes
from framewise.operators import audio, carry, evaluate
from framewise.plans import analogues as an
from framewise.plans.catalog import JUDGED, RESULTS, query
from framewise.plans.persist import shared_dir
from framewise.session import table
from framewise.sources import config, files, framed, logs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/framewise-logs/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, folder: str, contents: dict[str, bytes]) -> None:
    """Write a few files by name into a folder that all executors share."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, data in contents.items():
        out = fs.create(path(f"{folder}/{name}"))
        out.write(bytearray(data))
        out.close()


# ---- logs ----------------------------------------------------------------------------------------


@query(
    "sc1_sc2_result_log",
    f"""WITH {RESULTS}, r AS (SELECT status, expected, classified, CAST(elapsed AS DOUBLE) AS elapsed, source, reason, seq FROM rs)
    SELECT status, expected, classified, elapsed, source, reason, count(*) AS n FROM (SELECT * FROM r UNION ALL SELECT * FROM r WHERE seq % 3 = 1) GROUP BY ALL""",
)
def _(spark, d):
    path = _folder(spark, "results")
    # A third of the objects on a line each, a third twice on one line, a third over several lines.
    third = F.col("seq") % 3
    text = F.when(third == 0, F.col("json")).when(third == 1, F.concat("json", F.lit(" "), "json")).otherwise(F.to_json(F.from_json("json", logs.RESULT), {"pretty": "true"}))
    an.result_lines(spark, d).select(text.alias("value")).write.text(path)
    out, _ = logs.results(spark, path)
    fields = ["status", "expected", "classified", "elapsed", F.col("model_reply.source").alias("source"), F.col("model_reply.reason").alias("reason")]
    return out.select(*fields).groupBy("status", "expected", "classified", "elapsed", "source", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("sc3_label_map", "SELECT 'doc' || doc_id AS name, CASE WHEN quality = 1 THEN 'content' ELSE 'ad' END AS label FROM labels WHERE doc_id % 10 <> 0")
def _(spark, d):
    path = _folder(spark, "labels")
    label = F.when(F.col("doc_id") % 10 == 0, None).when(F.col("quality") == 1, "content").otherwise("ad")
    rows = table(spark, d, "labels").select(F.struct(F.concat(F.lit("doc"), "doc_id").alias("name"), label.alias("label")).alias("e"))
    whole = rows.agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    whole.select(F.to_json("m", {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)
    return logs.labels(spark, path, drop_null=True)


@query(
    "sc4_sc5_features_log",
    """SELECT 'doc' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'NBC' ELSE 'Fox' END AS network_logo,
      CASE WHEN doc_id % 3 <> 0 THEN 'center' END AS logo_position, CASE WHEN doc_id % 3 = 0 THEN 'top' END AS scoreboard_position FROM documents""",
)
def _(spark, d):
    path = _folder(spark, "features")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("filename"), "doc_id")
    logs.append(docs.select("filename", F.lit("Fox").alias("network_logo"), F.lit("center").alias("logo_position")), path)
    # Many small parts and one large one: the later call counts, whatever the size of its files.
    logs.append(docs.filter("doc_id % 3 = 0").repartition(7).select("filename", F.lit("NBC").alias("network_logo"), F.lit("top").alias("scoreboard_position")), path)
    return logs.features(spark, path)


@query(
    "sc11_sk4_overrides",
    "SELECT row_number() OVER (ORDER BY call, n_nationkey) - 1 AS pos, phash, label FROM (SELECT *, n_nationkey * 1000003 - 5 AS phash, CASE WHEN n_nationkey % 2 = 0 THEN 'ad' ELSE 'content' END AS label, CASE WHEN n_nationkey < 9 THEN 0 ELSE 1 END AS call FROM nation)",
)
def _(spark, d):
    path = _folder(spark, "overrides")
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").orderBy(n).select("n_nationkey", (n * 1000003 - 5).cast("long").alias("phash"), F.when(n % 2 == 0, "ad").otherwise("content").alias("label"))
    for part in (rows.filter("n_nationkey < 9"), rows.filter("n_nationkey >= 9")):
        logs.append_overrides(part.orderBy("n_nationkey").select("phash", "label"), path)
    return logs.overrides(spark, path).select(F.col("pos").cast("long").alias("pos"), "phash", "label")


@query(
    "sk1_saved_batches",
    """SELECT replace('2026-01-01T10:00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0'), ':', '-') || '_' || doc_id || '.jpg' AS filename,
      'periodic' AS save_reason, CASE WHEN doc_id % 5 = 0 THEN 'ad' ELSE 'content' END AS classification, md5(text) AS digest FROM documents""",
)
def _(spark, d):
    path = _folder(spark, "saved")
    n = F.col("doc_id")
    stamp = F.concat(F.lit("2026-01-01T10:00:"), F.lpad((n % 60).cast("string"), 2, "0"))
    rows = table(spark, d, "documents").select(
        n.alias("idx"), stamp.alias("timestamp"), F.lit(".jpg").alias("suffix"), F.encode("text", "UTF-8").alias("content"), F.when(n % 5 == 0, "ad").otherwise("content").alias("classification")
    )
    logs.save_batches(rows, path, "periodic")
    saved = logs.frame_contents(spark, path).select("filename", F.md5("content").alias("digest"))
    return logs.classifications(spark, f"{path}/classifications").join(saved, "filename").select("filename", "save_reason", "classification", "digest")


@query(
    "sk1_failed_parts",
    """SELECT doc_id || '.jpg' AS filename, md5(text) AS digest, CASE WHEN doc_id % 4 <> 1 THEN md5(lang) END AS sound FROM documents WHERE doc_id % 9 <> 0""",
)
def _(spark, d):
    """Frames of which some have no content, and so no record, and some no sound."""
    path = _folder(spark, "saved")
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        n.alias("idx"), F.lit("at").alias("timestamp"), F.lit(".jpg").alias("suffix"), F.when(n % 9 != 0, F.encode("text", "UTF-8")).alias("content"), F.when(n % 4 != 1, F.encode("lang", "UTF-8")).alias("audio")
    )
    logs.save_batches(rows, path, "manual_capture")
    frames = logs.frame_contents(spark, path).select("filename", F.md5("content").alias("digest"))
    sound = logs.frame_contents(spark, path, "audio").select(F.regexp_replace("filename", "wav$", "jpg").alias("filename"), F.md5("content").alias("sound"))
    found = logs.classifications(spark, f"{path}/classifications").select("filename").join(frames, "filename").join(sound, "filename", "left")
    return found.select(F.regexp_replace("filename", "^at_", "").alias("filename"), "digest", "sound")


@query(
    "sk5_summary_log",
    f"""WITH {JUDGED} SELECT count(*) FILTER (status IN ('correct', 'incorrect')) AS total, count(*) FILTER (status = 'incorrect') AS incorrect, count(*) AS lines FROM ju""",
)
def _(spark, d):
    path = _folder(spark, "evaluation")
    judged = evaluate.judged(an.verdicts(spark, d), an.labels(spark, d))
    logs.write_evaluation(judged.select(evaluate.log_record().alias("r")).select("r.*"), evaluate.summary(judged), path)
    rows, summaries = logs.results(spark, path)
    one = summaries.select(F.from_json("json", "total long, incorrect long").alias("s")).select("s.*")
    return one.crossJoin(rows.agg(F.count(F.lit(1)).alias("lines")))


# ---- folders and settings ------------------------------------------------------------------------

_FILE = """CASE n_nationkey % 3 WHEN 0 THEN 'frame' || n_nationkey || '.png' WHEN 1 THEN '2026-02-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '_10-00.jpg' ELSE '2026-01-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'T23-59-59-000001_3.jpeg' END"""


def _file_names(spark: SparkSession, d: str) -> list[tuple[str, bytes]]:
    """25 names in both conventions, and contents; nation is a table of fixed size."""
    rows = table(spark, d, "nation").select(F.expr(_FILE.replace("AS VARCHAR", "AS STRING")).alias("f"), "n_name").collect()
    return [(r["f"], r["n_name"].encode()) for r in rows]


@query("sc6_sc8_listing", f"SELECT {_FILE} AS name, strlen(n_name) AS size FROM nation")
def _(spark, d):
    folder = _folder(spark, "frames")
    _put(spark, folder, {**dict(_file_names(spark, d)), "notes.txt": b"x", "upper.JPG": b"y"})
    return files.listing(spark, folder).select("name", "size")


@query(
    "sc7_sc21_evaluation_listing",
    f"SELECT name FROM (SELECT {_FILE} AS name FROM nation) WHERE name LIKE '%.png' OR name LIKE '%.jpg'",
)
def _(spark, d):
    folder = _folder(spark, "evaluation-frames")
    _put(spark, f"{folder}/images", dict(_file_names(spark, d)))
    return files.evaluation_listing(spark, folder)


@query("sc9_contents", f"SELECT md5(n_name) AS digest, {_FILE} AS name FROM nation")
def _(spark, d):
    folder = _folder(spark, "contents")
    _put(spark, folder, dict(_file_names(spark, d)))
    return files.contents(spark, folder).select("name", F.md5("content").alias("digest"))


@query(
    "sc15_settings",
    """SELECT s_suppkey AS n, 'http://m:' || s_suppkey AS matrix_url, s_suppkey % 3 = 0 AS enable_debounce, ['nascar_on_fox', 'nascar_on_nbc', 'nhra_on_fox'][s_suppkey % 3 + 1] AS classifier_profile,
      CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 20 ELSE 10 END AS BIGINT) AS phash_threshold FROM supplier""",
)
def _(spark, d):
    """Settings of as many installations as there are suppliers: a JSON text with keys in any case, and an environment that wins."""
    n = F.col("s_suppkey")
    choice = F.element_at(F.array(F.lit("nascar_on_fox"), F.lit("nascar_on_nbc"), F.lit("nhra_on_fox")), (n % 3 + 1).cast("int"))
    own = F.struct(F.lit("http://file").alias("MATRIX_URL"), choice.alias("Classifier_Profile"), F.when(n % 2 == 0, n % 20).alias("phash_threshold"), F.lit(1).alias("unknown"))
    rows = table(spark, d, "supplier").select(n.alias("n"), F.to_json(own).alias("json"), F.concat(F.lit("http://m:"), n.cast("string")).alias("url"), F.when(n % 3 == 0, "Yes").otherwise("false").alias("debounce"))

    def loaded(parts):
        for part in parts:
            found = [config.parsed(j, {"DETECTOR_MATRIX_URL": u, "DETECTOR_ENABLE_DEBOUNCE": b}) for j, u, b in zip(part["json"], part["url"], part["debounce"], strict=True)]
            yield part[["n"]].assign(**{k: [getattr(c, k) for c in found] for k in ("matrix_url", "enable_debounce", "classifier_profile", "phash_threshold")})

    return rows.mapInPandas(loaded, "n long, matrix_url string, enable_debounce boolean, classifier_profile string, phash_threshold long")


@query(
    "f10_sc20_requests",
    """SELECT n_nationkey AS n, k.kind, CASE k.kind WHEN 'full' THEN 500 ELSE 10 END AS most, CASE WHEN k.kind = 'full' THEN 'Say ad or racing.' WHEN n_nationkey % 2 = 0 THEN 'This image and' ELSE 'Does this image' END AS question,
      'data:image/jpeg;base64,' || base64(encode(n_name)) AS url, CASE WHEN n_nationkey % 2 = 0 THEN base64(encode(n_name || '!')) END AS audio, 'local' AS model FROM nation, (VALUES ('quick'), ('full')) AS k(kind)""",
)
def _(spark, d):
    folder = _folder(spark, "prompt")
    _put(spark, folder, {"prompt.txt": b"Say ad or racing."})
    rows = table(spark, d, "nation").crossJoin(F.broadcast(files.prompt(spark, f"{folder}/prompt.txt")))
    image, audio = F.encode("n_name", "UTF-8"), F.when(F.col("n_nationkey") % 2 == 0, F.encode(F.concat("n_name", F.lit("!")), "UTF-8"))
    made = [rows.select(F.col("n_nationkey").alias("n"), F.lit(kind).alias("kind"), replies.request(kind, "local", image, F.col("prompt"), audio).alias("r")) for kind in ("quick", "full")]
    get = lambda path: F.get_json_object("r", path)
    text = get("$.messages[0].content[0].text")
    question = F.when(F.col("kind") == "full", text).when(text.startswith("This"), F.substring(text, 1, 14)).otherwise(F.substring(text, 1, 15))
    return made[0].unionByName(made[1]).select(
        "n", "kind", get("$.max_tokens").cast("int").alias("most"), question.alias("question"), get("$.messages[0].content[1].image_url.url").alias("url"),
        get("$.messages[0].content[2].input_audio.data").alias("audio"), get("$.model").alias("model"),
    )


@query(
    "o7_profiles",
    "SELECT event_id, profile, profile IN ('nascar_on_fox', 'nascar_on_hbo_max', 'nascar_on_nbc', 'nhra_on_fox') AS known FROM (SELECT event_id, ['nascar_on_fox', 'nascar_on_hbo_max', 'nascar_on_nbc', 'nhra_on_fox', event_type, 'NHRA_on_fox'][event_id % 6 + 1] AS profile FROM events)",
)
def _(spark, d):
    """Requests for a profile by name, some of them unknown."""
    asked = F.array(*map(F.lit, profiles.profile_names()), F.col("event_type"), F.lit("NHRA_on_fox"))
    rows = table(spark, d, "events").select("event_id", F.element_at(asked, (F.col("event_id") % 6 + 1).cast("int")).alias("profile"))
    return rows.withColumn("known", F.col("profile").isin(*profiles.profile_names()))


_DOMAIN = ", ".join(f"'{v}'" for v in checks.NETWORK_LOGOS)


@query(
    "o4_domain",
    f"SELECT event_id, logo IS NULL OR logo IN ({_DOMAIN}) AS ok FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Fox' WHEN 1 THEN 'fox' WHEN 2 THEN NULL ELSE event_type END AS logo FROM events)",
)
def _(spark, d):
    m = F.col("event_id") % 4
    logo = F.when(m == 0, "Fox").when(m == 1, "fox").when(m == 3, F.col("event_type"))
    return table(spark, d, "events").withColumn("network_logo", logo).select("event_id", checks.in_domain("network_logo").alias("ok"))


# ---- pixels --------------------------------------------------------------------------------------


def _grey(value: str, width: int, height: int) -> F.Column:
    """Pixels of an image whose columns have the brightness value (SQL in x), as blue, green, red."""
    row = f"array_join(transform(sequence(0, {width - 1}), x -> repeat(lpad(hex(CAST({value} AS bigint)), 2, '0'), 3)), '')"
    return F.expr(f"unhex(repeat({row}, {height}))")


@query("f1_dhash", "SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE 0 END AS dhash FROM nation")
def _(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.lit(36).alias("height"), F.lit(45).alias("width"), _grey("IF(n_nationkey % 2 = 0, x * 5 + n_nationkey, 255 - x * 5 - n_nationkey)", 45, 36).alias("data"))
    return rows.select("n", pixels.hashes("height", "width", "data")["dhash"].alias("dhash"))


@query(
    "f2_f3_a17_template",
    """SELECT n_nationkey AS n, 1.0::DOUBLE AS score, n_nationkey AS x, n_nationkey % 5 AS y, round(36.0 / 960, 6)::DOUBLE AS share, 0.0::DOUBLE AS difference FROM nation""",
)
def _(spark, d):
    """A bright 6 x 6 patch with a dark middle at (n, n % 5) of a dark 40 x 24 image; the template has a margin of nothing."""

    @F.pandas_udf("binary")
    def painted(n: pd.Series) -> pd.Series:
        def paint(k: int) -> bytes:
            img = np.zeros((24, 40, 3), np.uint8)
            img[k % 5 : k % 5 + 8, k : k + 8] = patch
            return img.tobytes()

        return n.map(paint)

    patch = np.zeros((8, 8, 3), np.uint8)
    patch[1:7, 1:7] = np.arange(220, 256).reshape(6, 6, 1)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), painted("n_nationkey").alias("data"))
    side = lambda h, w: (F.lit(h), F.lit(w))
    m = pixels.matches(*side(24, 40), F.col("data"), *side(8, 8), F.lit(bytearray(patch.tobytes())))
    out = rows.select("n", m.alias("m"))
    return out.select("n", F.round("m.score", 6).alias("score"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.round("m.share", 6).alias("share"), F.round("m.difference", 6).alias("difference"))


@query(
    "sk11_thumbnails",
    """SELECT n_nationkey AS n, CAST(CASE WHEN w <= 400 THEN 8 ELSE greatest(1, round(8 * 400.0 / w)) END AS INTEGER) AS height, CAST(least(w, 400) AS INTEGER) AS width,
      md5(repeat(' ', CAST(CASE WHEN w <= 400 THEN 8 ELSE greatest(1, round(8 * 400.0 / w)) END * least(w, 400) * 3 AS INTEGER))) AS digest FROM (SELECT n_nationkey, 380 + n_nationkey * 7 AS w FROM nation)""",
)
def _(spark, d):
    width = F.expr("380 + n_nationkey * 7")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.lit(8).alias("height"), width.cast("int").alias("width"))
    rows = rows.withColumn("data", F.expr("unhex(repeat('20', 8 * width * 3))"))
    out = rows.select("n", pixels.thumbnails("height", "width", "data").alias("t"))
    return out.select("n", _little("t", 1).alias("height"), _little("t", 5).alias("width"), F.md5(F.expr("substring(t, 9)")).alias("digest"))


def _little(column: str, at: int) -> F.Column:
    """A 4-byte number in a binary column, lowest byte first."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(column), at + i, 1)), 16, 10).cast("int")
    return sum((byte(i) * 256**i for i in range(1, 4)), byte(0))


@query(
    "f4_rectangles",
    """SELECT n_nationkey AS n, 10 + n_nationkey AS x, 7 + n_nationkey AS y, 81 + n_nationkey AS w, 61 + n_nationkey AS h FROM nation WHERE (80 + n_nationkey) * (60 + n_nationkey) >= 6000""",
)
def _(spark, d):
    """A bright box on a dark ground, at (n + 11, n + 8), 80 + n wide and 60 + n high: of the two pixels at an edge the first is its place. Small boxes do not count."""

    @F.pandas_udf("binary")
    def painted(n: pd.Series) -> pd.Series:
        def paint(k: int) -> bytes:
            img = np.full((140, 180, 3), 20, np.uint8)
            img[8 + k : 68 + 2 * k, 11 + k : 91 + 2 * k] = 220
            if (80 + k) * (60 + k) < 6000:
                img[40:] = 20  # half of it and less
            return img.tobytes()

        return n.map(paint)

    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), painted("n_nationkey").alias("data"))
    return rows.select("n", F.inline(shapes.detected(F.lit(140), F.lit(180), "data")))


@query(
    "j12_f6_f9_profiles",
    """SELECT profile, n_nationkey AS n,
      CASE WHEN k = 3 THEN 'phash_override' WHEN profile = 'nascar_on_nbc' AND k = 2 THEN 'llm' WHEN profile = 'nhra_on_fox' AND k <> 4 THEN 'default' ELSE 'opencv' END AS source,
      CASE WHEN k = 3 THEN 'ad' WHEN profile = 'nascar_on_nbc' THEN CASE k WHEN 0 THEN 'content' WHEN 1 THEN 'ad' WHEN 2 THEN 'unknown' ELSE 'content' END
           ELSE CASE WHEN k = 4 THEN 'content' ELSE 'ad' END END AS type,
      CASE WHEN k = 3 THEN 'phash_override' WHEN profile = 'nascar_on_nbc' THEN CASE k WHEN 0 THEN 'network_logo' WHEN 1 THEN 'side_by_side' WHEN 2 THEN 'no_model' ELSE 'network_logo' END
           ELSE CASE WHEN k = 4 THEN 'network_logo' ELSE 'default_ad' END END AS reason
    FROM (SELECT *, n_nationkey % 5 AS k FROM nation), (VALUES ('nascar_on_nbc'), ('nhra_on_fox')) AS p(profile)""",
)
def _(spark, d):
    """Made frames of full size: 0 the peacock in its window, 1 the split screen and the peacock, 2 the peacock elsewhere, 3 known, 4 the white word mark."""
    rng = np.random.default_rng(3)
    peacock = rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    white = np.repeat(rng.integers(0, 2, (20, 60, 1)) * 255, 3, axis=2).astype(np.uint8)

    @F.pandas_udf("binary")
    def painted(k: pd.Series) -> pd.Series:
        def paint(kind: int) -> bytes:
            img = np.full((1080, 1920, 3), 30, np.uint8)
            if kind in (0, 1):
                img[70:100, 1790:1830] = peacock
            if kind == 1:
                img[100:120, 50:110] = white
            if kind == 2:
                img[500:530, 900:940] = peacock
            if kind == 4:
                img[80:100, 1800:1860] = white
            return img.tobytes()

        return k.map(paint)

    k = F.col("n_nationkey") % 5
    rows = table(spark, d, "nation").repartition(8, "n_nationkey").select(
        F.col("n_nationkey").alias("n"), F.lit(1080).alias("height"), F.lit(1920).alias("width"), painted(k.cast("int")).alias("data"), F.when(k == 3, "ad").alias("override")
    )
    scorers = profiles.Scorers({"peacock": [peacock], "side_by_side": [white], "usa": [white], "logo": [white]})
    each = [profiles.classified(rows, p, scorers).select(F.lit(p).alias("profile"), "n", "result.source", "result.type", "result.reason") for p in ("nascar_on_nbc", "nhra_on_fox")]
    return each[0].unionByName(each[1])


@query("sc8_any_case_listing", f"SELECT {_FILE} AS name, strlen(n_name) AS size FROM nation UNION ALL SELECT 'UP' || n_nationkey || '.JPG', 1 FROM nation WHERE n_nationkey % 5 = 0")
def _(spark, d):
    folder = _folder(spark, "any-case")
    _put(spark, folder, {**dict(_file_names(spark, d)), "notes.txt": b"x"})
    upper = table(spark, d, "nation").filter("n_nationkey % 5 = 0").select(F.format_string("UP%d.JPG", "n_nationkey").alias("src"), F.lit("y").alias("text"))
    carry.put(upper, folder)
    return files.listing(spark, folder, any_case=True).select("name", "size")


#: 64 bits, the highest first, as a signed number.
_SIGNED = "CAST(CASE WHEN {0} >= CAST(9223372036854775808 AS HUGEINT) THEN {0} - CAST(18446744073709551616 AS HUGEINT) ELSE {0} END AS BIGINT)"


@query(
    "sc9_sc10_decoded",
    f"""WITH s AS (SELECT s_suppkey AS n, sum(CASE WHEN (s_suppkey >> CAST(r AS INTEGER)) & 1 = 1 THEN CAST(255 AS HUGEINT) << CAST(8 * (7 - r) AS INTEGER) ELSE 0 END) AS v FROM supplier, range(8) AS t(r) GROUP BY ALL)
    SELECT 'f' || n || CASE WHEN n % 2 = 0 THEN '.png' ELSE '.PNG' END AS name, n % 7 = 3 OR n % 11 = 5 AS damaged, CASE WHEN NOT (n % 7 = 3 OR n % 11 = 5) THEN {_SIGNED.format('v')} END AS dhash FROM s""",
)
def _(spark, d):
    """PNG files of 9 x 8 pixels, row r rising where bit r of the key is set; some are cut short, some are text."""

    @F.pandas_udf("binary")
    def painted(n: pd.Series) -> pd.Series:
        def paint(k: int) -> bytes:
            up = np.arange(9) * 20
            img = np.stack([up if k >> r & 1 else up[::-1] for r in range(8)])
            made = encode.png(np.repeat(img[..., None], 3, axis=2).astype(np.uint8))
            return made[:50] if k % 7 == 3 else b"no picture" if k % 11 == 5 else made

        return n.map(paint)

    folder = _folder(spark, "pictures")
    n = F.col("s_suppkey")
    name = F.concat(F.lit("f"), n.cast("string"), F.when(n % 2 == 0, ".png").otherwise(".PNG"))
    carry.put(table(spark, d, "supplier").select(name.alias("src"), painted(n.cast("long")).alias("text")), folder)
    hashes, errors = files.hashed(spark, folder)
    return hashes.select("name", F.lit(False).alias("damaged"), "dhash").unionByName(errors.select("name", F.lit(True).alias("damaged"), F.lit(None).cast("long").alias("dhash")))


@query(
    "f1_phash",
    f"""WITH p AS (SELECT s_suppkey AS n, x, y, (x * x * (s_suppkey % 97 + 3) + y * y * 5 + x * y * 7 * (s_suppkey % 89 + 1)) % 256 AS v FROM supplier, range(32) AS a(x), range(32) AS b(y)),
    r AS (SELECT n, y, u, sum(v * cos(pi() / 32 * (x + 0.5) * u)) AS s FROM p, range(8) AS c(u) GROUP BY ALL),
    c AS (SELECT n, u, w, sum(s * cos(pi() / 32 * (y + 0.5) * w)) AS f FROM r, range(8) AS c(w) GROUP BY ALL),
    m AS (SELECT *, median(f) OVER (PARTITION BY n) AS mid FROM c),
    h AS (SELECT n, sum(CASE WHEN f > mid THEN CAST(1 AS HUGEINT) << CAST(63 - 8 * w - u AS INTEGER) ELSE 0 END) AS v FROM m GROUP BY n)
    SELECT n, {_SIGNED.format('v')} AS phash FROM h""",
)
def _(spark, d):
    """Images of 32 x 32 from a formula, against the cosines written out."""

    @F.pandas_udf("binary")
    def painted(n: pd.Series) -> pd.Series:
        y, x = np.mgrid[0:32, 0:32]
        paint = lambda k: np.repeat(((x * x * (k % 97 + 3) + y * y * 5 + x * y * 7 * (k % 89 + 1)) % 256)[..., None], 3, axis=2).astype(np.uint8).tobytes()
        return n.map(paint)

    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("n"), painted(F.col("s_suppkey").cast("long")).alias("data"))
    return rows.select("n", pixels.hashes(F.lit(32), F.lit(32), "data")["phash"].alias("phash"))


@query(
    "f6_f8_profiles",
    """SELECT profile, n_nationkey AS n, CASE WHEN profile = 'nascar_on_fox' THEN CASE k WHEN 3 THEN 'llm' ELSE 'opencv' END ELSE CASE WHEN k IN (3, 4) THEN 'opencv' ELSE 'default' END END AS source,
      CASE WHEN profile = 'nascar_on_fox' THEN CASE k WHEN 0 THEN 'content' WHEN 4 THEN 'content' ELSE 'ad' END ELSE CASE k WHEN 4 THEN 'ad' ELSE 'content' END END AS type,
      CASE WHEN profile = 'nascar_on_fox' THEN CASE k WHEN 0 THEN 'network_logo' WHEN 1 THEN 'side_by_side' WHEN 2 THEN 'matched_rectangle' WHEN 3 THEN 'model_quick_reject' ELSE 'network_logo' END
           ELSE CASE k WHEN 3 THEN 'commercial_break_racing' WHEN 4 THEN 'well_be_back' ELSE 'default_fallback' END END AS reason
    FROM (SELECT *, n_nationkey % 5 AS k FROM nation), (VALUES ('nascar_on_fox'), ('nascar_on_hbo_max')) AS p(profile)""",
)
def _(spark, d):
    """Made frames of full size: 0 the logo, 1 the split screen's mark, 2 a box in a known place, 3 a banner, 4 the logo and the other banner."""
    rng = np.random.default_rng(5)
    logo, mark, racing, back = (np.repeat(rng.integers(0, 2, (h, w, 1)) * 255, 3, axis=2).astype(np.uint8) for h, w in ((24, 60), (20, 50), (30, 80), (26, 90)))

    @F.pandas_udf("binary")
    def painted(k: pd.Series) -> pd.Series:
        def paint(kind: int) -> bytes:
            img = np.full((1080, 1920, 3), 30, np.uint8)
            if kind in (0, 4):
                img[60:84, 1700:1760] = logo
            if kind == 1:
                img[100:120, 90:140] = mark
            if kind == 2:
                img[253 : 253 + 585, 789 : 789 + 1041] = 200
            if kind == 3:
                img[600:630, 900:980] = racing
            if kind == 4:
                img[900:926, 300:390] = back
            return img.tobytes()

        return k.map(paint)

    k = F.col("n_nationkey") % 5
    rows = table(spark, d, "nation").repartition(8, "n_nationkey").select(F.col("n_nationkey").alias("n"), F.lit(1080).alias("height"), F.lit(1920).alias("width"), painted(k.cast("int")).alias("data"))
    scorers = profiles.Scorers({"logo": [logo], "side_by_side": [mark], "in_progress": [racing], "be_back": [back]}, ask_quick=lambda img: False)
    each = [profiles.classified(rows, p, scorers, None).select(F.lit(p).alias("profile"), "n", "result.source", "result.type", "result.reason") for p in ("nascar_on_fox", "nascar_on_hbo_max")]
    return each[0].unionByName(each[1])


@query(
    "f10_prepared",
    """SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 = 0 THEN 450 WHEN n_nationkey % 3 = 1 THEN 800 ELSE 300 END AS height, CASE WHEN n_nationkey % 3 = 0 THEN 800 WHEN n_nationkey % 3 = 1 THEN 450 ELSE 400 END AS width, TRUE AS near FROM nation""",
)
def _(spark, d):
    """Pictures for a model: reduced to 800, written as JPEG files, read by Spark, and compared with what they show: a slope of brightness that ends at a value of the key."""
    size = {0: (900, 1600), 1: (1600, 900), 2: (300, 400)}

    @F.pandas_udf("binary")
    def painted(n: pd.Series) -> pd.Series:
        def paint(k: int) -> bytes:
            h, w = size[k % 3]
            slope = np.linspace(40, 150 + k, w)
            return np.broadcast_to(np.stack([slope, slope / 2, 200 - slope], axis=1), (h, w, 3)).astype(np.uint8).tobytes()

        return n.map(paint)

    @F.pandas_udf("boolean")
    def near(n: pd.Series, height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
        def good(k: int, h: int, w: int, x: bytes) -> bool:
            got, slope = pixels.image(h, w, x).astype(float), np.linspace(40, 150 + k, w)
            return bool(np.abs(got - np.stack([slope, slope / 2, 200 - slope], axis=1)).mean() < 4)

        return pd.Series([good(*x) for x in zip(n, height, width, data, strict=True)])

    folder, k = _folder(spark, "prepared"), F.col("n_nationkey")
    side = lambda i: F.element_at(F.array(*[F.lit(size[j][i]) for j in range(3)]), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "nation").repartition(8, "n_nationkey").select("n_nationkey", side(0).alias("h"), side(1).alias("w"), painted(k.cast("long")).alias("data"))
    carry.put(rows.select(F.concat("n_nationkey", F.lit(".jpg")).alias("src"), encode.prepared("h", "w", "data").alias("text")), folder)
    back = files.images(spark, folder).withColumn("n", F.regexp_extract("name", r"^(\d+)", 1).cast("long"))
    return back.select("n", "height", "width", near("n", "height", "width", "data").alias("near"))


# ---- sound and framed messages -------------------------------------------------------------------


@query(
    "w10_audio_slices",
    """WITH c AS (SELECT user_id AS key, ts, event_id AS seq, 2 + event_id % 5 AS n, substr(md5(CAST(event_id AS VARCHAR)), 1, CAST(4 * (2 + event_id % 5) AS INTEGER)) AS h FROM events WHERE event_id % 4 > 0),
    q AS (SELECT user_id AS key, ts, event_id AS seq, event_id % 40 AS want FROM events WHERE event_id % 4 = 0),
    p AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts, seq) AS e FROM c),
    s AS (SELECT key, ts, seq, e, e - n AS s, e - n + i AS sample, substr(h, CAST(4 * i + 1 AS INTEGER), 4) AS x FROM (SELECT *, unnest(range(n)) AS i FROM p)),
    a AS (SELECT q.key, q.seq, q.want, max(s.e) AS total FROM q LEFT JOIN s ON s.key = q.key AND (s.ts, s.seq) <= (q.ts, q.seq) GROUP BY ALL),
    k AS (SELECT a.key, a.seq, a.want, string_agg(s.x, '' ORDER BY s.sample) FILTER (s.sample >= a.total - a.want) AS x, count(s.x) AS held
      FROM a LEFT JOIN s ON s.key = a.key AND s.e <= a.total AND s.s >= a.total - 30 GROUP BY ALL),
    w AS (SELECT key, seq, CASE WHEN held = 0 THEN repeat('0000', CAST(want AS INTEGER)) ELSE coalesce(x, '') END AS x FROM k)
    SELECT key, seq, CAST(length(x) // 4 AS BIGINT) AS n_samples, '52494646' || lpad(printf('%X', length(x) // 2 + 36), 2, '0') || '00000057415645666D74201000000001000100E8030000D00700000200100064617461'
      || lpad(printf('%X', length(x) // 2), 2, '0') || '000000' || upper(x) AS wav FROM w""",
)
def _(spark, d):
    """Chunks of two to six samples from events at 1,000 samples a second, a ring of 30 ms, and slices of 0 to 39 ms, whole."""
    n = F.col("seq")
    rows = an.frames(spark, d)
    pcm = F.unhex(F.substring(F.md5(n.cast("string")), F.lit(1), (4 * (2 + n % 5)).cast("int")))
    out = audio.slices(rows.filter(n % 4 > 0).withColumn("pcm", pcm), rows.filter(n % 4 == 0).withColumn("ms", n % 40), 1000, 1, 0.03)
    return out.select("key", "seq", "n_samples", F.hex("wav").alias("wav"))


@query("sc18_framed_messages", "SELECT CAST(event_id // 200 AS VARCHAR) AS stream, event_id, user_id, event_type, round(value, 6) AS value FROM events")
def _(spark, d):
    """Streams of two hundred messages, cut into parts of 1 to 613 bytes wherever that is; a third of the messages is longer than a part."""
    rows = table(spark, d, "events").select((F.col("event_id") / 200).cast("long").alias("stream"), "event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
    noise = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("{"), (F.col("event_id") % 2000).cast("int"))).otherwise("")
    payload = F.encode(F.to_json(F.struct("event_id", "user_id", "event_type", "value", noise.alias("noise"))), "UTF-8")
    whole = rows.select("stream", "event_id", F.hex(framed.framed(payload)).alias("x")).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("event_id", "x"))).alias("m"))
    # Bytes, not text: a place in a text is found by counting from its start.
    whole = whole.select("stream", F.unhex(F.array_join(F.transform("m", lambda m: m["x"]), "")).alias("x"))
    # Cut places that grow by 1 to 613 bytes.
    cuts = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (F.octet_length("x") / 307 + 1).cast("long"))))
    place = lambda i: i * 307 + F.pmod(F.xxhash64("stream", i), F.lit(306))
    a, b = F.when(F.col("part") > 0, place(F.col("part"))).otherwise(0), place(F.col("part") + 1)
    parts = cuts.select("stream", "part", F.substring("x", (a + 1).cast("int"), (b - a).cast("int")).alias("data"))
    found = framed.messages(parts).filter("complete")
    told = F.from_json(F.decode("payload", "UTF-8"), "event_id long, user_id long, event_type string, value double").alias("m")
    return found.select("stream", told).select("stream", "m.*")
