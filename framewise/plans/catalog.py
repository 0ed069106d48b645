"""Registry of the queries over the supplied tables and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from framewise.functions import bits, checks, names, profiles, replies
from framewise.operators import boxes, carry, catalogue, dedupe, evaluate, outputs, state
from framewise.plans import analogues as an
from framewise.session import table
from framewise.sources import files, store
from framewise.streaming import feed, live, overrides, requests, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# ---- SQL of the analogues -------------------------------------------------------------------------

FRAMES = """fr AS (SELECT user_id AS key, ts, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type IN ('purchase', 'click') THEN 'ad' ELSE 'content' END AS result,
  CASE WHEN event_id % 5 = 0 THEN 'opencv' ELSE 'llm' END AS source, value AS elapsed FROM events)"""

LOG = f"""{FRAMES}, lg AS (SELECT key, ts, seq, source, seq % 40 < 20 AS flag,
  CASE seq % 20 WHEN 1 THEN 'report' WHEN 2 THEN 'pause' WHEN 3 THEN 'resume' WHEN 4 THEN 'debounce' WHEN 5 THEN 'auto' WHEN 6 THEN 'trigger' ELSE 'frame' END AS kind,
  CASE WHEN seq % 20 IN (1, 6) THEN CASE WHEN result = 'unknown' THEN 'ad' ELSE result END WHEN seq % 20 IN (2, 3, 4, 5) THEN NULL ELSE result END AS result
  FROM fr)"""

DEBOUNCED = f"""{FRAMES}, d1 AS (
  SELECT *, last_value(CASE WHEN result <> 'unknown' THEN result END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    last_value(CASE WHEN result <> 'unknown' THEN result END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_result
  FROM fr), d2 AS (
  SELECT *, CASE WHEN result IN ('ad', 'content') AND (source = 'opencv' OR coalesce(result = prev, FALSE)) THEN result END AS setv FROM d1), db AS (
  SELECT *, last_value(setv IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_before,
    last_value(setv IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS committed FROM d2)"""

SUSPICIOUS = "result IN ('ad', 'content') AND prev IS NOT NULL AND result <> prev AND result IS DISTINCT FROM state_before"

REPLAYED = f"""{LOG}, r1 AS (
  SELECT *, last_value(CASE WHEN kind = 'report' OR (kind = 'frame' AND result <> 'unknown') THEN result END IGNORE NULLS) OVER b AS prev,
    coalesce(last_value(CASE WHEN kind = 'debounce' THEN flag END IGNORE NULLS) OVER u, TRUE) AS deb,
    coalesce(last_value(CASE kind WHEN 'auto' THEN flag WHEN 'trigger' THEN FALSE WHEN 'resume' THEN TRUE END IGNORE NULLS) OVER u, TRUE) AS auto_switch
  FROM lg WINDOW b AS (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), r2 AS (
  SELECT *, CASE WHEN kind = 'report' THEN result WHEN kind = 'frame' AND result IN ('ad', 'content') AND (source = 'opencv' OR coalesce(result = prev, FALSE) OR NOT deb) THEN result END AS setv,
    CASE WHEN kind = 'pause' OR (kind = 'report' AND auto_switch) THEN epoch(ts) + 30 WHEN kind = 'resume' THEN -1.0 END AS setp FROM r1), r3 AS (
  SELECT *, last_value(setv IGNORE NULLS) OVER b AS state_before, last_value(setv IGNORE NULLS) OVER u AS committed, last_value(setp IGNORE NULLS) OVER u AS paused_until
  FROM r2 WINDOW b AS (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), rp AS (
  SELECT *, coalesce(paused_until > epoch(ts), FALSE) AS paused,
    kind = 'frame' AND setv IS NOT NULL AND setv IS DISTINCT FROM state_before AS changed,
    kind = 'frame' AND coalesce({SUSPICIOUS}, FALSE) AS suspicious,
    CASE WHEN kind = 'frame' AND setv IS NOT NULL AND setv IS DISTINCT FROM state_before AND auto_switch AND NOT coalesce(paused_until > epoch(ts), FALSE) THEN setv
         WHEN kind = 'resume' AND committed IN ('ad', 'content') THEN committed
         WHEN (kind = 'report' AND flag) OR kind = 'trigger' THEN result END AS emits FROM r3)"""

NAMES = """nm AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'frame' || event_id || '.png'
    WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.jpg'
    WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H-%M-%S') || '-000123_' || (event_id % 12) || '.jpg'
    ELSE strftime(ts, '%Y-%m-%d_%H-%M') || '.jpeg' END AS name, event_id, ts FROM events)"""

_RE = r"^(\d{4})-(\d{2})-(\d{2})[T_](\d{2})-(\d{2})(?:-(\d{2}))?(?:-(\d+))?(?:_(\d+))?"
_PARTS = ", ".join(f"coalesce(CAST(nullif(regexp_extract(name, '{_RE}', {i}), '') AS BIGINT), 0) AS t{i}" for i in range(1, 9))
ANNOTATED = f"""{NAMES}, an0 AS (SELECT name, min(event_id) AS n FROM nm GROUP BY name), an AS (SELECT name,
    CASE n % 4 WHEN 0 THEN 'ad' WHEN 1 THEN 'content' WHEN 2 THEN 'ignore' END AS label,
    CASE WHEN n % 5 < 3 THEN ['Fox', 'NBC', 'none'][n % 3 + 1] END AS network_logo,
    CASE WHEN n % 7 < 5 THEN 'upper_left' END AS logo_position,
    CASE WHEN n % 2 = 0 THEN 'top' WHEN n % 9 = 1 THEN '' END AS scoreboard_position,
    NOT regexp_matches(name, '{_RE}') AS untimed, {_PARTS} FROM an0)"""
ASC = "untimed, t1, t2, t3, t4, t5, t6, t7, t8, name"
DESC = ", ".join(f"{c.strip()} DESC" for c in ASC.split(","))
INCOMPLETE = "(coalesce(label, '') = '' OR coalesce(network_logo, '') = '' OR coalesce(logo_position, '') = '' OR coalesce(scoreboard_position, '') = '')"

JUDGED = """ju AS (SELECT d.*, l.label AS expected,
    CASE WHEN l.label IS NULL THEN 'unlabeled' WHEN l.label = 'ignore' THEN 'ignored' WHEN l.label = d.classified THEN 'correct' ELSE 'incorrect' END AS status
  FROM (SELECT 'doc' || doc_id AS name, doc_id AS position, CASE WHEN doc_id % 11 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'ad' ELSE 'content' END AS classified, (doc_id % 400) / 64.0::DOUBLE AS elapsed FROM documents) d
  LEFT JOIN (SELECT 'doc' || doc_id AS name, CASE WHEN toxic = 1 THEN 'ignore' WHEN quality = 1 THEN 'content' ELSE 'ad' END AS label FROM labels) l USING (name))"""

RESULTS = f"""{FRAMES}, rs0 AS (SELECT seq, result, source, elapsed, CASE WHEN seq % 7 = 0 THEN 'unknown' WHEN seq % 2 = 0 THEN 'ad' ELSE 'content' END AS ex FROM fr), rs AS (
  SELECT CASE WHEN seq % 13 = 0 THEN 'ignored' WHEN ex = result THEN 'correct' ELSE 'incorrect' END AS status,
    CASE WHEN seq % 13 <> 0 THEN ex END AS expected, CASE WHEN seq % 13 <> 0 THEN result END AS classified,
    CASE WHEN seq % 13 <> 0 THEN CASE WHEN seq % 3 = 0 THEN 'network_logo' ELSE 'model-match' END END AS reason,
    CASE WHEN seq % 13 <> 0 THEN source END AS source,
    CASE WHEN seq % 13 <> 0 THEN CAST(round(elapsed, 3) AS DECIMAL(18, 3)) END AS elapsed, seq FROM rs0)"""

HASHES = """hs0 AS (SELECT vec_id AS n, label,
    array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS p,
    array_to_string(list_transform(range(64), lambda i: CASE WHEN embedding[(i + 1) % 64 + 1] - embedding[i + 1] > 0 THEN '1' ELSE '0' END), '') AS d FROM embeddings), hs1 AS (
  SELECT n, label, p, d FROM hs0 UNION ALL
  SELECT n + 100000000, CAST((label + 1) % 3 AS INTEGER),
    array_to_string(list_transform(range(64), lambda i: CASE WHEN i IN (n % 60, n % 60 + 2) THEN CASE WHEN p[i + 1] = '1' THEN '0' ELSE '1' END ELSE p[i + 1] END), ''),
    array_to_string(list_transform(range(64), lambda i: CASE WHEN n % 2 = 1 OR i IN (n % 60, n % 60 + 1) THEN CASE WHEN d[i + 1] = '1' THEN '0' ELSE '1' END ELSE d[i + 1] END), '')
  FROM hs0 WHERE n % 5 = 0), hs AS (
  SELECT 'frame' || lpad(CAST(n AS VARCHAR), 9, '0') || '.jpg' AS name, n, n % 1000 + 1 AS size, p, d, label,
    CASE label WHEN 0 THEN 'ad' WHEN 1 THEN 'content' ELSE 'ignore' END AS tag, n % 50 = 0 AS protected FROM hs1)"""


# ---- G1: result logs -----------------------------------------------------------------------------


@query(
    "a1_mean_by_group",
    f"WITH {RESULTS} SELECT status, expected, classified, round(avg(elapsed), 2) AS avg_elapsed FROM rs WHERE source = 'llm' AND expected <> 'unknown' GROUP BY ALL",
)
def _(spark, d):
    return evaluate.mean_by_group(evaluate.results_view(an.result_lines(spark, d), "results"))


def _pivot_sql(by: str, on: str, values: list[str]) -> str:
    cols = ", ".join(
        f"round(avg(elapsed) FILTER ({on} = '{v}'), 2) AS {v}_avg_elapsed, round(CAST(max(elapsed) FILTER ({on} = '{v}') AS DOUBLE), 2) AS {v}_max_elapsed"
        for v in values
    )
    return f"WITH {RESULTS} SELECT {by}, {cols} FROM rs WHERE expected <> 'unknown' GROUP BY {by}"


@query("a2_pivot_classified", _pivot_sql("expected", "classified", ["ad", "content", "unknown"]))
def _(spark, d):
    return evaluate.pivoted(evaluate.results_view(an.result_lines(spark, d)), ["expected"], "classified", ["ad", "content", "unknown"])


@query("a3_pivot_expected", _pivot_sql("classified, reason", "expected", ["ad", "content"]))
def _(spark, d):
    return evaluate.pivoted(evaluate.results_view(an.result_lines(spark, d)), ["classified", "reason"], "expected", ["ad", "content"])


@query("p1_json_fields", f"WITH {RESULTS} SELECT status, expected, classified, reason, source, elapsed, count(*) AS n FROM rs GROUP BY ALL")
def _(spark, d):
    rows = evaluate.results_view(an.result_lines(spark, d))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p21_viewer_filter",
    f"WITH {RESULTS} SELECT expected, classified, count(*) AS n FROM rs WHERE status = 'incorrect' AND reason = 'model-match' AND expected = 'ad' GROUP BY ALL",
)
def _(spark, d):
    rows = evaluate.results_view(an.result_lines(spark, d))
    wanted = checks.all_selected({"status": "incorrect", "reason": "model-match", "expected": "ad"})
    return rows.filter(wanted).groupBy("expected", "classified").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a14_choices",
    f"WITH {RESULTS} SELECT DISTINCT 'reason' AS field, reason AS value FROM rs WHERE reason IS NOT NULL UNION SELECT DISTINCT 'expected', expected FROM rs WHERE expected IS NOT NULL",
)
def _(spark, d):
    return evaluate.distinct_values(evaluate.results_view(an.result_lines(spark, d)), ["reason", "expected"])


# ---- G3: evaluation ------------------------------------------------------------------------------


def _judged(spark, d):
    return evaluate.judged(an.verdicts(spark, d), an.labels(spark, d))


@query("p17_status", f"WITH {JUDGED} SELECT name, expected, classified, status FROM ju")
def _(spark, d):
    return _judged(spark, d).select("name", "expected", "classified", "status")


@query(
    "a4_summary",
    f"""WITH {JUDGED}, c AS (SELECT count(*) FILTER (status IN ('correct', 'incorrect')) AS total, count(*) FILTER (status = 'incorrect') AS incorrect,
    count(*) FILTER (status = 'unlabeled') AS unlabeled, count(*) FILTER (status = 'ignored') AS ignored FROM ju)
    SELECT *, coalesce(round(incorrect / nullif(total, 0), 4), 0.0) AS incorrect_pct FROM c""",
)
def _(spark, d):
    return evaluate.summary(_judged(spark, d))


@query(
    "a5_timing",
    f"""WITH {JUDGED}, t AS (SELECT elapsed FROM ju WHERE status IN ('correct', 'incorrect'))
    SELECT round(avg(elapsed), 2) AS avg_elapsed, round(list_sort(list(elapsed))[count(*) // 2 + 1], 2) AS median_elapsed,
    round(min(elapsed), 2) AS min_elapsed, round(max(elapsed), 2) AS max_elapsed, round(sum(elapsed), 2) AS total_elapsed FROM t HAVING count(*) > 0""",
)
def _(spark, d):
    return evaluate.timing(_judged(spark, d))


@query(
    "a6_wrong_names",
    f"""WITH {JUDGED} SELECT CASE classified WHEN 'ad' THEN 'incorrectly_marked_as_ads' WHEN 'content' THEN 'incorrectly_marked_as_content' ELSE 'incorrectly_unknown' END AS bucket,
    position, name FROM ju WHERE status = 'incorrect'""",
)
def _(spark, d):
    return evaluate.wrong_names(_judged(spark, d))


@query(
    "a15_accuracy",
    f"""WITH {JUDGED}, g AS (SELECT expected, status FROM ju WHERE status IN ('correct', 'incorrect')), a AS (
    SELECT expected, count(*) AS n, round(avg(CASE WHEN status = 'correct' THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM g GROUP BY expected
    UNION ALL SELECT NULL, count(*), round(avg(CASE WHEN status = 'correct' THEN 1.0 ELSE 0.0 END), 4) FROM g)
    SELECT *, accuracy >= CASE WHEN expected IS NULL THEN 0.8 ELSE 0.75 END AS ok FROM a""",
)
def _(spark, d):
    return evaluate.meets(_judged(spark, d))


def _histogram_sql(bounds) -> str:
    parts = [f"SELECT CAST({float(b)} AS DOUBLE) AS le, count(*) FILTER (elapsed <= {b}) AS n FROM t" for b in bounds]
    return f"WITH {JUDGED}, t AS (SELECT elapsed FROM ju) " + " UNION ALL ".join([*parts, "SELECT NULL, count(elapsed) FROM t"])


@query("a18_classification_histogram", _histogram_sql(evaluate.CLASSIFICATION_BOUNDS))
def _(spark, d):
    return evaluate.histogram(an.verdicts(spark, d), "elapsed", evaluate.CLASSIFICATION_BOUNDS)


@query("sk13_switching_histogram", _histogram_sql(evaluate.SWITCHING_BOUNDS))
def _(spark, d):
    return evaluate.histogram(an.verdicts(spark, d), "elapsed", evaluate.SWITCHING_BOUNDS)


# ---- G2: catalogue -------------------------------------------------------------------------------


@query("o1_sort_keys", f"WITH {ANNOTATED} SELECT name, untimed, t1, t2, t3, t4, t5, t6, t7, t8 FROM an")
def _(spark, d):
    at = names.taken(F.col("name"))
    return an.annotated(spark, d).select(
        "name", at.isNull().alias("untimed"), *[F.coalesce(at[p], F.lit(0)).alias(f"t{i}") for i, p in enumerate(names.PARTS, 1)]
    )


def _page_sql(order: str, where: str = "TRUE", page: int = 1, per: int = 100) -> str:
    return f"""WITH {ANNOTATED}, k AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM an WHERE {where}),
    p AS (SELECT *, greatest(1, CAST(ceil(n / {per}) AS BIGINT)) AS pg FROM k)
    SELECT name, label, network_logo, logo_position, scoreboard_position, CAST(rn AS INTEGER) AS place,
      CAST(least({page}, pg) AS INTEGER) AS page, CAST(pg AS INTEGER) AS pages FROM p
    WHERE rn > (least({page}, pg) - 1) * {per} AND rn <= least({page}, pg) * {per}"""


@query("o1_first_page", _page_sql(ASC))
def _(spark, d):
    return catalogue.paged(an.annotated(spark, d))


@query("o2_descending_page", _page_sql(DESC, page=2, per=50))
def _(spark, d):
    return catalogue.paged(an.annotated(spark, d), page=2, per_page=50, order="desc")


@query("o3_clamped_page", _page_sql(ASC, page=999_999, per=500))
def _(spark, d):
    return catalogue.paged(an.annotated(spark, d), page=999_999, per_page=500)


_COLS = "name, label, network_logo, logo_position, scoreboard_position"


@query("p6_name_contains", f"WITH {ANNOTATED} SELECT {_COLS} FROM an WHERE contains(lower(name), 't1')")
def _(spark, d):
    return catalogue.filtered(an.annotated(spark, d), q="T1")


@query(
    "p8_time_range",
    f"WITH {ANNOTATED} SELECT {_COLS} FROM an WHERE NOT untimed AND t1 * 10000000000 + t2 * 100000000 + t3 * 1000000 + t4 * 10000 + t5 * 100 + t6 BETWEEN 20240105000000 AND 20240115143059",
)
def _(spark, d):
    return catalogue.filtered(an.annotated(spark, d), start="2024-01-05", end="2024-01-15T14:30")


@query("p9_unset", f"WITH {ANNOTATED} SELECT {_COLS} FROM an WHERE coalesce(scoreboard_position, '') = '' AND network_logo = 'Fox'")
def _(spark, d):
    return catalogue.filtered(an.annotated(spark, d), scoreboard_position=checks.UNSET, network_logo="Fox")


@query("p11_incomplete", f"WITH {ANNOTATED} SELECT {_COLS} FROM an WHERE {INCOMPLETE} AND label = 'ad'")
def _(spark, d):
    return catalogue.filtered(an.annotated(spark, d), label="ad", incomplete=True)


@query(
    "p12_domains",
    f"""WITH {ANNOTATED} SELECT name, label IS NULL OR label IN ('ad', 'content', 'ignore') AS label_ok,
    scoreboard_position IS NULL OR scoreboard_position IN ('top', 'bottom', 'left', 'upper_left', 'right', 'none', 'unknown') AS scoreboard_ok FROM an""",
)
def _(spark, d):
    return an.annotated(spark, d).select("name", checks.in_domain("label").alias("label_ok"), checks.in_domain("scoreboard_position").alias("scoreboard_ok"))


@query(
    "j1_j2_listing",
    f"""WITH {ANNOTATED}, l AS (SELECT name, label FROM an WHERE label IS NOT NULL), f AS (SELECT name, network_logo, logo_position, scoreboard_position FROM an WHERE network_logo IS NOT NULL)
    SELECT name, l.label, f.network_logo, f.logo_position, f.scoreboard_position FROM (SELECT DISTINCT name FROM nm) LEFT JOIN l USING (name) LEFT JOIN f USING (name)""",
)
def _(spark, d):
    rows = an.annotated(spark, d)
    labels = rows.filter("label IS NOT NULL").select("name", "label")
    features = rows.filter("network_logo IS NOT NULL").select("name", *checks.FEATURES)
    return catalogue.listing(an.names(spark, d).select("name").distinct(), labels, features)


@query(
    "w11_next_incomplete",
    """WITH c AS (SELECT conv_id, turn AS place, length(text) % 3 = 0 AS incomplete FROM conversations)
    SELECT *, min(CASE WHEN incomplete THEN place END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_incomplete,
      max(CASE WHEN incomplete THEN place END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_incomplete FROM c""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), (F.length("text") % 3 == 0).alias("incomplete"))
    return catalogue.neighbours(rows, ["conv_id"])


@query(
    "sk2_sk3_latest",
    f"""WITH {FRAMES}, r AS (SELECT key, result, CASE WHEN seq % 3 = 0 THEN NULL ELSE source END AS source, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM fr)
    SELECT key, result, source FROM r WHERE k = 1""",
)
def _(spark, d):
    log = an.frames(spark, d).select("key", "seq", "result", F.when(F.col("seq") % 3 != 0, F.col("source")).alias("source"))
    return catalogue.latest(log, "key", "seq")


@query(
    "p13_p14_suffixes",
    f"""WITH {NAMES} SELECT name, regexp_matches(name, '^[^/]+\\.(png|jpe?g)$') AS safe, regexp_replace(name, '\\.[^.]+$', '') AS stem,
    CASE WHEN lower(regexp_extract(upper(name), '(\\.[^.]+)$', 1)) IN ('.png', '.jpg', '.jpeg') THEN lower(regexp_extract(upper(name), '(\\.[^.]+)$', 1)) ELSE '.jpg' END AS suffix, count(*) AS n
    FROM nm GROUP BY ALL""",
)
def _(spark, d):
    name = F.col("name")
    rows = an.names(spark, d).select(
        "name",
        names.is_safe(name).alias("safe"),
        names.stem(name).alias("stem"),
        names.with_suffix(F.regexp_extract(F.upper(name), r"(\.[^.]+)$", 1), ".jpg").alias("suffix"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


# ---- G5: live state ------------------------------------------------------------------------------


@query("w1_previous_result", f"WITH {DEBOUNCED} SELECT key, seq, prev FROM db")
def _(spark, d):
    return state.debounced(an.frames(spark, d)).select("key", "seq", "prev")


@query(
    "w2_committed_state",
    f"WITH {DEBOUNCED} SELECT key, ts, seq, result, source, prev, committed, setv IS NOT NULL AND setv IS DISTINCT FROM state_before AS changed FROM db",
)
def _(spark, d):
    return state.debounced(an.frames(spark, d)).select("key", "ts", "seq", "result", "source", "prev", "committed", "changed")


@query("w3_suspicious", f"WITH {DEBOUNCED} SELECT key, seq, result, prev FROM db WHERE {SUSPICIOUS}")
def _(spark, d):
    return state.debounced(an.frames(spark, d)).filter("suspicious").select("key", "seq", "result", "prev")


@query(
    "w4_ring_buffer",
    f"WITH {FRAMES}, r AS (SELECT key, seq, result, CAST(row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS INTEGER) AS place FROM fr) SELECT * FROM r WHERE place <= 5",
)
def _(spark, d):
    return state.ring(an.frames(spark, d)).select("key", "seq", "result", "place")


@query(
    "w8_log_ring",
    f"WITH {FRAMES}, r AS (SELECT key, seq, CAST(row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS INTEGER) AS place FROM fr) SELECT * FROM r WHERE place <= 60",
)
def _(spark, d):
    return state.ring(an.frames(spark, d), 60).select("key", "seq", "place")


@query(
    "w5_saved_batches",
    f"""WITH {DEBOUNCED}, h AS (SELECT *, list(seq) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM db)
    SELECT key, seq AS at, CAST(generate_subscripts(held, 1) - 1 AS INTEGER) AS idx, unnest(held) AS seq FROM h WHERE {SUSPICIOUS}""",
)
def _(spark, d):
    return state.flushed(state.debounced(an.frames(spark, d)), F.col("suspicious"))


@query(
    "sk1_saved_names",
    f"""WITH {DEBOUNCED}, h AS (SELECT *, list(struct_pack(seq := seq, ts := ts)) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM db),
    f AS (SELECT seq AS at, generate_subscripts(held, 1) - 1 AS idx, unnest(held) AS s FROM h WHERE {SUSPICIOUS})
    SELECT "at", s.seq AS seq, replace(replace(strftime(s.ts, '%Y-%m-%dT%H:%M:%S.%f'), ':', '-'), '.', '-') || '_' || idx || '.jpg' AS filename, 'suspicious_debounce' AS save_reason FROM f""",
)
def _(spark, d):
    rows = an.frames(spark, d)
    saved = state.flushed(state.debounced(rows), F.col("suspicious"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return saved.join(rows.select("seq", "ts"), "seq").select(
        "at", "seq", names.batch_name(stamp, F.col("idx"), F.lit(".jpg")).alias("filename"), F.lit("suspicious_debounce").alias("save_reason")
    )


@query("w6_pending", f"WITH {DEBOUNCED} SELECT key, seq, last_result IS NOT NULL AND last_result IS DISTINCT FROM committed AS pending FROM db")
def _(spark, d):
    return state.debounced(an.frames(spark, d)).select("key", "seq", "pending")


@query("st1_replayed", f"WITH {REPLAYED} SELECT key, seq, kind, prev, committed, changed, suspicious FROM rp")
def _(spark, d):
    return state.replayed(an.command_log(spark, d)).select("key", "seq", "kind", "prev", "committed", "changed", "suspicious")


@query("w7_st5_paused", f"WITH {REPLAYED} SELECT key, seq, paused, paused_until FROM rp")
def _(spark, d):
    return state.replayed(an.command_log(spark, d)).select("key", "seq", "paused", "paused_until")


@query("st6_flags", f"WITH {REPLAYED} SELECT key, seq, auto_switch, deb AS debounce FROM rp")
def _(spark, d):
    return state.replayed(an.command_log(spark, d)).select("key", "seq", "auto_switch", "debounce")


@query("st7_switches", f"WITH {REPLAYED} SELECT key, ts, seq, kind, emits FROM rp WHERE emits IS NOT NULL")
def _(spark, d):
    return state.replayed(an.command_log(spark, d)).filter("emits IS NOT NULL").select("key", "ts", "seq", "kind", "emits")


SETTINGS = {"ad": {"label": "Alt view", "A": "1", "B": "4", "C": "9"}, "content": {"label": "Race view", "A": "4", "B": "1"}}


@query(
    "sk9_switch_commands",
    f"""WITH {REPLAYED} SELECT key, seq, emits AS classification, o.output, o.input FROM rp
    JOIN (VALUES ('ad', 'A', 1), ('ad', 'B', 4), ('content', 'A', 4), ('content', 'B', 1)) AS o(c, output, input) ON emits = c""",
)
def _(spark, d):
    emitted = state.replayed(an.command_log(spark, d)).filter("emits IS NOT NULL").select("key", "seq", F.col("emits").alias("classification"))
    return outputs.commands(emitted, SETTINGS)


@query(
    "p27_status_line",
    f"""WITH {REPLAYED}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS k,
      last_value(CASE WHEN kind = 'report' OR (kind = 'frame' AND result <> 'unknown') THEN result END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lr FROM rp)
    SELECT key, committed AS classification, lr IS NOT NULL AND lr IS DISTINCT FROM committed AS pending, auto_switch, 'Ad view' AS ad_view_label, 'Race view' AS race_view_label,
      CASE WHEN paused THEN paused_until END AS auto_switch_paused_until FROM s WHERE k = 1""",
)
def _(spark, d):
    rows = state.replayed(an.command_log(spark, d))
    known = F.when((F.col("kind") == "report") | ((F.col("kind") == "frame") & (F.col("result") != "unknown")), F.col("result"))
    rows = rows.withColumn("last_result", state.upto(known))
    rows = rows.withColumn("pending", F.col("last_result").isNotNull() & ~F.col("last_result").eqNullSafe(F.col("committed")))
    return outputs.status(state.ring(rows, 1))


@query(
    "st6_profile_in_force",
    f"""WITH {FRAMES} SELECT key, seq, coalesce(last_value(CASE WHEN seq % 9 = 4 THEN ['nascar_on_fox', 'nascar_on_hbo_max', 'nascar_on_nbc', 'nhra_on_fox'][seq % 4 + 1] END IGNORE NULLS)
      OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'nascar_on_fox') AS profile FROM fr""",
)
def _(spark, d):
    n = F.col("seq")
    command = F.when(n % 9 == 4, F.element_at(F.array(*map(F.lit, profiles.profile_names())), (n % 4 + 1).cast("int")))
    return state.in_force(an.frames(spark, d), command, "nascar_on_fox").select("key", "seq", F.col("in_force").alias("profile"))


@query(
    "p28_display",
    f"WITH {DEBOUNCED} SELECT CASE WHEN committed IS NULL THEN '...' WHEN committed = 'ad' THEN 'AD' WHEN committed = 'content' THEN 'RACING' ELSE '?' END AS shown, count(*) AS n FROM db GROUP BY ALL",
)
def _(spark, d):
    rows = state.debounced(an.frames(spark, d)).select(replies.display(F.col("committed")).alias("shown"))
    return rows.groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st8_periodic_saves",
    f"""WITH {FRAMES}, p AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS saved_at FROM fr), r AS (SELECT *, row_number() OVER (PARTITION BY key, saved_at ORDER BY ts DESC, seq DESC) AS k FROM p)
    SELECT key, saved_at, seq, CAST(row_number() OVER (PARTITION BY key, saved_at ORDER BY ts, seq) - 1 AS INTEGER) AS idx FROM r WHERE k <= 5""",
)
def _(spark, d):
    return state.periodic(an.frames(spark, d), "1 hour").select("key", "saved_at", "seq", "idx")


@query(
    "w9_recently_seeked",
    f"""WITH {FRAMES}, s AS (SELECT key, seq, epoch(ts) - last_value(CASE WHEN source = 'opencv' THEN epoch(ts) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM fr)
    SELECT key, seq, since, coalesce(since <= 3600.0, FALSE) AS recent FROM s""",
)
def _(spark, d):
    return state.recently(an.frames(spark, d), F.col("source") == "opencv", 3600.0).select("key", "seq", "since", "recent")


@query(
    "sc13_p30_requests",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'frame' WHEN event_type = 'click' THEN 'seeking' WHEN event_type IN ('view', 'click') THEN 'paused' ELSE 'reject' END AS branch FROM events""",
)
def _(spark, d):
    kind = F.col("event_type")
    branch = replies.request_branch(F.col("event_id") % 4 == 0, kind == "click", kind.isin("view", "click"))
    return table(spark, d, "events").select("event_id", branch.alias("branch"))


@query(
    "sc12_p15_p16_fields",
    """SELECT event_id, event_id % 4 < 3 AS truthy, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS seconds,
    coalesce(json_extract_string(props, '$.k'), '?') AS shown FROM events""",
)
def _(spark, d):
    o = replies.offset(F.get_json_object("props", "$.k"))
    given = F.element_at(F.array(F.lit("True"), F.lit("1"), F.lit("YES"), F.col("event_type")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", replies.truthy(given).alias("truthy"), o["seconds"].alias("seconds"), o["shown"].alias("shown"))


@query(
    "sc19_recent_by_time",
    f"""WITH {FRAMES}, r AS (SELECT key, ts, seq, result, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS place FROM fr) SELECT key, ts, seq, result FROM r WHERE place <= 5 AND date_part('hour', ts) = 12""",
)
def _(spark, d):
    return state.ring(an.frames(spark, d)).filter(F.hour("ts") == 12).select("key", "ts", "seq", "result")


@query(
    "sk12_last_frame",
    f"WITH {FRAMES} SELECT key, arg_max(result, (ts, seq)) AS result, max(ts) AS ts FROM fr GROUP BY key",
)
def _(spark, d):
    last = F.max_by("result", F.struct("ts", "seq")).alias("result")
    return an.frames(spark, d).groupBy("key").agg(last, F.max("ts").alias("ts"))


# ---- G4: duplicates ------------------------------------------------------------------------------


@query(
    "a7_exact_groups",
    "SELECT md5(text) AS digest, count(*) AS n, arg_min('doc' || doc_id, doc_id) AS keep FROM documents GROUP BY md5(text) HAVING count(*) > 1",
)
def _(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("doc_id").alias("pos"), F.encode("text", "UTF-8").alias("content"))
    return dedupe.exact_groups(files)


def _tagged(spark, d):
    rows = an.near_hashes(spark, d)
    tag = F.when(F.col("label") == 0, "ad").when(F.col("label") == 1, "content").otherwise("ignore")
    return rows.withColumns({"tag": tag, "protected": F.col("n") % 50 == 0}).drop("label")


@query(
    "j5_label_conflicts",
    f"""WITH {HASHES}, k AS (SELECT * FROM hs WHERE n % 3 <> 0) SELECT a.name AS name_a, a.tag AS label_a, b.name AS name_b, b.tag AS label_b, CAST(hamming(a.p, b.p) AS INTEGER) AS distance
    FROM k a JOIN k b ON a.n < b.n AND a.tag <> b.tag AND hamming(a.p, b.p) <= 10""",
)
def _(spark, d):
    rows = _tagged(spark, d).withColumn("pos", F.col("n"))
    labels = rows.filter("n % 3 <> 0").select("name", F.col("tag").alias("label"))
    return dedupe.conflicts(rows.select("name", "phash", "pos"), labels)


def _greedy_sql(threshold: int, dhash: bool) -> str:
    far = f"hamming(d, near.d) > {threshold + 4}" if dhash else "FALSE"
    return f"""WITH RECURSIVE {HASHES}, o AS (SELECT *, row_number() OVER (ORDER BY NOT protected, n) AS i FROM hs), g AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(name VARCHAR, p VARCHAR, d VARCHAR)[]) AS kept, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS representative, CAST(NULL AS INTEGER) AS distance
      UNION ALL
      SELECT i, CASE WHEN drop_it THEN kept ELSE list_append(kept, struct_pack(name := name, p := p, d := d)) END, name, CASE WHEN drop_it THEN near.name END, CASE WHEN drop_it THEN CAST(dist AS INTEGER) END FROM (
        SELECT *, near IS NOT NULL AND dist <= {threshold} AND NOT protected AND NOT coalesce({far}, FALSE) AS drop_it FROM (
          SELECT *, hamming(p, near.p) AS dist FROM (
            SELECT o.i, o.name, o.p, o.d, o.protected, g.kept,
              kept[list_position(list_transform(kept, lambda x: hamming(x.p, o.p)), list_min(list_transform(kept, lambda x: hamming(x.p, o.p))))] AS near
            FROM g JOIN o ON o.i = g.i + 1))))
    SELECT name, representative IS NULL AS kept, representative, distance FROM g WHERE i > 0"""


def _decided(spark, d, threshold=10, use_dhash=True):
    rows = _tagged(spark, d)
    guarded = rows.filter("protected").select("name")
    return dedupe.kept_first(dedupe.ordered(rows.select("name", "phash", "dhash"), guarded), threshold, use_dhash)


@query("a10_j6_greedy_keep_first", _greedy_sql(10, True))
def _(spark, d):
    return _decided(spark, d)


@query("a10_greedy_phash_only", _greedy_sql(16, False))
def _(spark, d):
    return _decided(spark, d, 16, False)


@query("a11_drop_histogram", f"WITH q AS ({_greedy_sql(10, True)}) SELECT distance, count(*) AS n FROM q WHERE NOT kept GROUP BY distance")
def _(spark, d):
    return dedupe.distances(_decided(spark, d))


def _cluster_sql(threshold: int) -> str:
    return f"""WITH RECURSIVE {HASHES}, o AS (SELECT *, row_number() OVER (ORDER BY n) AS i FROM hs), g AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(name VARCHAR, p VARCHAR)[]) AS kept, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS leader, CAST(NULL AS INTEGER) AS distance
      UNION ALL
      SELECT i, CASE WHEN lead IS NULL THEN list_append(kept, struct_pack(name := name, p := p)) ELSE kept END, name, coalesce(lead.name, name), CAST(coalesce(hamming(p, lead.p), 0) AS INTEGER) FROM (
        SELECT o.i, o.name, o.p, g.kept, list_filter(kept, lambda x: hamming(x.p, o.p) <= {threshold})[1] AS lead FROM g JOIN o ON o.i = g.i + 1))
    SELECT leader, name, distance FROM g WHERE i > 0"""


@query("a8_leader_clusters", _cluster_sql(10))
def _(spark, d):
    rows = _tagged(spark, d)
    return dedupe.clusters(rows.select("name", "phash", F.col("n").alias("pos")), 10)


_NUMBER = "CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN p[i + 1] = '1' THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT)"
_REPORT = _cluster_sql(10).replace(
    "o AS (SELECT *, row_number() OVER (ORDER BY n) AS i FROM hs)",
    f"""dg AS (SELECT *, md5(CAST(CASE WHEN p[64] = '1' THEN {_NUMBER} - CAST(18446744073709551616 AS HUGEINT) ELSE {_NUMBER} END AS VARCHAR)) AS digest FROM hs),
    ex AS (SELECT digest, count(*) AS c, arg_min(name, n) AS keep FROM dg GROUP BY digest), o AS (SELECT dg.*, row_number() OVER (ORDER BY n) AS i FROM dg JOIN ex ON ex.digest = dg.digest AND keep = name)""",
)


@query(
    "a9_sk14_report",
    _REPORT.replace(
        "SELECT leader, name, distance FROM g WHERE i > 0",
        """SELECT 'exact' AS kind, '{"digest":"' || digest || '","n":' || c || ',"keep":"' || keep || '"}' AS json FROM ex WHERE c > 1
        UNION ALL SELECT 'near', '{"leader":"' || leader || '","name":"' || name || '","distance":' || distance || '}' FROM g WHERE i > 0 AND leader <> name""",
    ),
)
def _(spark, d):
    rows = _tagged(spark, d)
    files = rows.select("name", F.col("n").alias("pos"), F.col("phash").cast("string").cast("binary").alias("content"))
    return dedupe.report(files, rows.select("name", "phash", F.col("n").alias("pos")), 10)


@query(
    "a20_u2_protected",
    f"WITH {ANNOTATED} SELECT name FROM an WHERE label IS NOT NULL UNION SELECT name FROM an WHERE network_logo IS NOT NULL",
)
def _(spark, d):
    rows = an.annotated(spark, d)
    return dedupe.protected(rows.select("name", "label"), rows.filter("network_logo IS NOT NULL").select("name"))


@query(
    "p20_u3_removals",
    f"""WITH q AS ({_greedy_sql(10, True)}), {HASHES} SELECT name, 'duplicate' AS why FROM q WHERE NOT kept
    UNION ALL SELECT name, 'blank' FROM hs WHERE n % 7 = 0 AND NOT protected AND name NOT IN (SELECT name FROM q WHERE NOT kept)""",
)
def _(spark, d):
    rows = _tagged(spark, d)
    blank = rows.withColumn("phash", F.when(F.col("n") % 14 == 0, F.lit(0x80).cast("long")).when(F.col("n") % 7 == 0, F.lit(0).cast("long")).otherwise(F.col("phash")))
    return dedupe.removals(_decided(spark, d), blank, rows.filter("protected").select("name"))


@query(
    "a12_j11_reclaimed",
    f"""WITH q AS ({_greedy_sql(10, True)}), {HASHES}, m AS (SELECT name, 'image' AS medium, size FROM hs UNION ALL SELECT replace(name, '.jpg', '.wav'), 'audio', size * 2 FROM hs WHERE n % 2 = 0),
    j AS (SELECT m.*, q.name IS NOT NULL AS gone FROM m LEFT JOIN (SELECT name FROM q WHERE NOT kept) q ON replace(q.name, '.jpg', '') = replace(replace(m.name, '.jpg', ''), '.wav', ''))
    SELECT medium, count(*) FILTER (gone) AS n, CAST(coalesce(sum(size) FILTER (gone), 0) AS BIGINT) AS bytes,
      round(100.0 * CAST(coalesce(sum(size) FILTER (gone), 0) AS DOUBLE) / CAST(sum(size) AS DOUBLE), 1) AS percent FROM j GROUP BY medium""",
)
def _(spark, d):
    rows = _tagged(spark, d)
    images = rows.select("name", F.lit("image").alias("medium"), "size")
    audio = rows.filter("n % 2 = 0").select(F.concat(names.stem(F.col("name")), F.lit(".wav")).alias("name"), F.lit("audio").alias("medium"), F.col("size") * 2)
    return dedupe.reclaimed(_decided(spark, d).filter("NOT kept"), images.union(audio))


@query(
    "j4_sk6_pruned",
    f"WITH q AS ({_greedy_sql(10, True)}), {HASHES} SELECT name, tag FROM hs WHERE name NOT IN (SELECT name FROM q WHERE NOT kept)",
)
def _(spark, d):
    return dedupe.pruned(_tagged(spark, d).select("name", "tag"), _decided(spark, d).filter("NOT kept"))


@query(
    "j3_labelled_only",
    f"WITH {JUDGED} SELECT name, classified FROM ju WHERE expected IS NOT NULL",
)
def _(spark, d):
    return an.verdicts(spark, d).join(an.labels(spark, d), "name", "left_semi").select("name", "classified")


@query(
    "j7_override_lookup",
    f"""WITH {HASHES}, o AS (SELECT n AS pos, p, tag FROM hs WHERE n % 40 = 0), m AS (SELECT hs.name, arg_min(o.tag, o.pos) AS label FROM hs JOIN o ON hamming(hs.p, o.p) <= 10 GROUP BY hs.name)
    SELECT name, m.label FROM hs LEFT JOIN m USING (name)""",
)
def _(spark, d):
    rows = _tagged(spark, d)
    listed = rows.filter("n % 40 = 0").select(F.col("n").alias("pos"), "phash", F.col("tag").alias("label"))
    return dedupe.overridden(rows.select("name", "phash"), listed)


@query(
    "j10_flagged",
    f"""WITH {FRAMES}, h AS (SELECT ts, min(seq) AS seq FROM fr WHERE key % 3 = 0 GROUP BY ts), i AS (SELECT seq AS n, ts, CASE WHEN seq % 3 = 0 THEN 'ignore' WHEN seq % 3 = 1 THEN 'ad' ELSE 'content' END AS label FROM fr WHERE seq % 4 <> 0)
    SELECT n, seq, label FROM i JOIN h USING (ts) WHERE label <> 'ignore'""",
)
def _(spark, d):
    rows = an.frames(spark, d)
    n = F.col("seq")
    items = rows.select(n.alias("n"), "ts", F.when(n % 3 == 0, "ignore").when(n % 3 == 1, "ad").otherwise("content").alias("label"), (n % 4 != 0).alias("phash"))
    return dedupe.flagged(items, rows.filter("key % 3 = 0").select("ts", "seq"))


@query(
    "p29_a13_moves",
    """WITH f AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'compressed_' || doc_id || '.JPG' WHEN 1 THEN doc_id || '.png' WHEN 2 THEN doc_id || '.wav' ELSE doc_id || '.json' END AS name FROM documents),
    m AS (SELECT CASE WHEN name LIKE 'compressed%' THEN 'thumbnails' WHEN name LIKE '%.png' THEN 'images' WHEN name LIKE '%.wav' THEN 'audio' END AS folder FROM f)
    SELECT folder, count(*) AS n FROM m WHERE folder IS NOT NULL GROUP BY folder""",
)
def _(spark, d):
    n = F.col("doc_id")
    m, text = n % 4, n.cast("string")
    name = F.when(m == 0, F.concat(F.lit("compressed_"), text, F.lit(".JPG"))).otherwise(F.concat(text, F.element_at(F.array(F.lit(".png"), F.lit(".wav"), F.lit(".json")), F.greatest(m, F.lit(1)).cast("int"))))
    return outputs.moves_by_folder(outputs.moves(table(spark, d, "documents").select(name.alias("name"))))


@query(
    "sk8_move_plan",
    "SELECT doc_id || '.png' AS name, 'images/' || doc_id || '.png' AS dest FROM documents WHERE doc_id % 3 <> 0",
)
def _(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    docs = table(spark, d, "documents")
    there = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("images/"), name).alias("dest"))
    return outputs.moves(docs.select(name.alias("name")), there)


@query("u1_u4_union_listing", f"WITH {NAMES} SELECT name, count(*) AS n FROM (SELECT name FROM nm WHERE name LIKE '%.png' UNION ALL SELECT name FROM nm WHERE name LIKE '%.jpg') GROUP BY name")
def _(spark, d):
    rows = an.names(spark, d).select("name")
    both = rows.filter(F.col("name").endswith(".png")).unionByName(rows.filter(F.col("name").endswith(".jpg")))
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f1_hash_text",
    f"WITH {HASHES} SELECT name, CAST(length(replace(p, '0', '')) AS INTEGER) AS ones, CAST(hamming(p, d) AS INTEGER) AS apart FROM hs",
)
def _(spark, d):
    back = bits.from_hex(bits.to_hex(F.col("phash")))
    return _tagged(spark, d).select("name", F.bit_count(back).cast("int").alias("ones"), bits.distance(back, F.col("dhash")).alias("apart"))


# ---- G6: replies and rectangles ------------------------------------------------------------------

_REPLY = """rp0 AS (SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'Type=AD because ' || text WHEN 1 THEN 'type=racing' WHEN 2 THEN '{"classification": "ad"}'
    WHEN 3 THEN 'So: {"a": 1, "classification" : "racing"} ok' WHEN 4 THEN '{"classification":"\\u0061d"}' WHEN 5 THEN NULL WHEN 6 THEN ' Yes, it is' ELSE text END AS reply FROM conversations)"""


def _replies(spark, d):
    m, text = F.col("turn") % 8, F.col("text")
    fixed = {1: "type=racing", 2: '{"classification": "ad"}', 3: 'So: {"a": 1, "classification" : "racing"} ok', 4: '{"classification":"\\u0061d"}', 6: " Yes, it is"}
    reply = F.when(m == 0, F.concat(F.lit("Type=AD because "), text)).when(m == 7, text)
    for k, v in fixed.items():
        reply = reply.when(m == k, v)
    return table(spark, d, "conversations").select("conv_id", "turn", reply.alias("reply"))


@query(
    "p22_p25_reply_verdict",
    rf"""WITH {_REPLY}, l AS (SELECT *, lower(regexp_replace(reply, '^\s+|\s+$', '', 'g')) AS t FROM rp0)
    SELECT conv_id, turn, CASE WHEN reply IS NULL THEN 'unknown' WHEN regexp_matches(t, '\btype=ad\b|"classification"\s*:\s*"ad"') THEN 'ad'
      WHEN regexp_matches(t, '\btype=racing\b|"classification"\s*:\s*"racing"') THEN 'content'
      WHEN turn % 8 = 4 AND json_extract_string(t, '$.classification') = 'ad' THEN 'ad' ELSE 'unknown' END AS type,
      CASE WHEN reply IS NULL THEN 'empty_response' ELSE 'model-match' END AS reason FROM l""",
)
def _(spark, d):
    v = replies.verdict(F.col("reply"))
    return _replies(spark, d).select("conv_id", "turn", v["type"].alias("type"), v["reason"].alias("reason"))


@query("p23_json_part", rf"WITH {_REPLY} SELECT conv_id, turn, nullif(regexp_extract(reply, '(?s)(\{{.*\}})', 1), '') AS json FROM rp0")
def _(spark, d):
    return _replies(spark, d).select("conv_id", "turn", replies.json_part(F.col("reply")).alias("json"))


@query("p24_yes", f"WITH {_REPLY} SELECT conv_id, turn, coalesce(contains(lower(trim(reply)), 'yes'), FALSE) AS yes FROM rp0")
def _(spark, d):
    return _replies(spark, d).select("conv_id", "turn", replies.says_yes(F.col("reply")).alias("yes"))


@query(
    "f11_json_contract",
    f"""WITH {_REPLY} SELECT conv_id, turn, CASE turn % 8 WHEN 2 THEN 'ad' WHEN 3 THEN 'racing' WHEN 4 THEN 'ad' END AS classification FROM rp0 WHERE turn % 8 IN (1, 2, 3, 4)""",
)
def _(spark, d):
    rows = _replies(spark, d).filter("turn % 8 IN (1, 2, 3, 4)")
    return rows.select("conv_id", "turn", F.from_json(replies.json_part(F.col("reply")), replies.CONTRACT)["classification"].alias("classification"))


_RECTS = """rc AS (SELECT l_orderkey AS frame_id, l_linenumber AS idx, l_partkey % 60 + CASE WHEN l_linenumber % 2 = 0 THEN 770 ELSE 0 END AS x, 220 + l_suppkey % 60 AS y,
    700 + l_partkey % 350 AS w, 380 + l_orderkey % 200 AS h, 1920 AS width, 1080 AS height FROM lineitem),
  bx AS (SELECT * FROM (VALUES (0, 'fox-side-by-side-left', 0.000, 0.239, 0.387, 0.381), (1, 'fox-side-by-side-right', 0.411, 0.234, 0.542, 0.542), (2, 'fox-side-by-side-scoreboard', 0.022, 0.029, 0.792, 0.176)) AS t(prio, box, bx, by_, bw, bh)),
  mt AS (SELECT frame_id, idx, prio, box, sqrt(pow(x / width - bx, 2) + pow(y / height - by_, 2) + pow(w / width - bw, 2) + pow(h / height - bh, 2)) AS distance FROM rc, bx)"""


def _rectangles(spark, d):
    line = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        line.alias("idx"),
        (F.col("l_partkey") % 60 + F.when(line % 2 == 0, 770).otherwise(0)).alias("x"),
        (220 + F.col("l_suppkey") % 60).alias("y"),
        (700 + F.col("l_partkey") % 350).alias("w"),
        (380 + F.col("l_orderkey") % 200).alias("h"),
        F.lit(1920).alias("width"),
        F.lit(1080).alias("height"),
    )


@query("j8_rectangle_matches", f"WITH {_RECTS} SELECT frame_id, idx, CAST(prio AS INTEGER) AS prio, box FROM mt WHERE distance <= 0.05")
def _(spark, d):
    return boxes.matches(_rectangles(spark, d), boxes.known(spark)).drop("distance")


@query("j9_first_box", f"WITH {_RECTS} SELECT frame_id, arg_min(box, prio) AS box FROM mt WHERE distance <= 0.05 GROUP BY frame_id")
def _(spark, d):
    return boxes.first_box(boxes.matches(_rectangles(spark, d), boxes.known(spark)))


@query(
    "a16_any_all",
    f"WITH {FRAMES} SELECT key, bool_or(result = 'unknown') AS some, bool_and(elapsed > 0) AS every FROM fr GROUP BY key",
)
def _(spark, d):
    return an.frames(spark, d).groupBy("key").agg(F.bool_or(F.col("result") == "unknown").alias("some"), F.bool_and(F.col("elapsed") > 0).alias("every"))


@query("a19_largest_video", "SELECT l_orderkey AS page, arg_max(l_linenumber, (l_quantity * l_suppkey, -l_linenumber)) AS idx FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rows = table(spark, d, "lineitem")
    return boxes.largest(rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("w"), F.col("l_suppkey").alias("h")))


@query(
    "fn_scalars",
    r"""SELECT doc_id, md5(text) AS digest, base64(encode(substr(text, 1, 12))) AS b64,
      CASE WHEN n_chars * 100000 >= 1073741824 THEN printf('%.2f GiB', n_chars * 100000 / 1073741824.0::DOUBLE) ELSE printf('%.2f MiB', n_chars * 100000 / 1048576.0::DOUBLE) END AS size_text,
      CAST(ceil(n_chars / 100) AS BIGINT) AS pages, array_to_string(list_sort(list_distinct(string_split(lang || ',' || source || ',' || lang, ','))), '+') AS parts FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        F.md5("text").alias("digest"),
        F.base64(F.encode(F.substring("text", 1, 12), "UTF-8")).alias("b64"),
        outputs.size_text(F.col("n_chars") * 100000).alias("size_text"),
        F.ceil(F.col("n_chars") / 100).cast("long").alias("pages"),
        F.array_join(F.array_sort(F.array_distinct(F.split(F.concat_ws(",", "lang", "source", "lang"), ","))), "+").alias("parts"),
    )



@query(
    "sc14_one_off_saves",
    """SELECT event_id, coalesce(strftime(TRY_CAST(stamp AS TIMESTAMP), '%Y-%m-%d_%H-%M-%S'), 'now') || suffix AS filename FROM (
      SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END END AS stamp,
        CASE WHEN event_id % 3 = 0 THEN '.jpeg' ELSE '.png' END AS suffix FROM events)""",
)
def _(spark, d):
    n = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 2 == 0, "Z").otherwise(""))
    stamp = F.when(n % 10 == 0, "soon").otherwise(text)
    suffix = names.with_suffix(F.when(n % 3 == 0, ".JPEG").otherwise(".gif"), ".png")
    at = F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd_HH-mm-ss")
    # The application takes the present time for a stamp that cannot be read; a fixed text keeps the query repeatable.
    return table(spark, d, "events").select("event_id", F.concat(F.coalesce(at, F.lit("now")), suffix).alias("filename"))


@query(
    "sk7_delete_list",
    f"""WITH q AS ({_greedy_sql(10, True)}), {HASHES}, m AS (SELECT 'images/' || name AS path, replace(name, '.jpg', '') AS stem FROM hs
      UNION ALL SELECT 'thumbnails/' || name, replace(name, '.jpg', '') FROM hs WHERE n % 3 = 0 UNION ALL SELECT 'audio/' || replace(name, '.jpg', '.wav'), replace(name, '.jpg', '') FROM hs WHERE n % 2 = 0)
    SELECT path FROM m WHERE stem IN (SELECT replace(name, '.jpg', '') FROM q WHERE NOT kept)""",
)
def _(spark, d):
    rows = _tagged(spark, d)
    media = rows.select(F.concat(F.lit("images/"), "name").alias("path"), "name")
    media = media.unionByName(rows.filter("n % 3 = 0").select(F.concat(F.lit("thumbnails/"), "name").alias("path"), "name"))
    audio = F.concat(names.stem(F.col("name")), F.lit(".wav"))
    media = media.unionByName(rows.filter("n % 2 = 0").select(F.concat(F.lit("audio/"), audio).alias("path"), "name"))
    gone = _decided(spark, d).filter("NOT kept").select(names.stem(F.col("name")).alias("stem"))
    return media.withColumn("stem", names.stem(F.col("name"))).join(gone, "stem", "left_semi").select("path")


@query(
    "st3_capture",
    f"""WITH {FRAMES}, h AS (SELECT *, list(seq) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM fr)
    SELECT key, seq AS "at", CAST(generate_subscripts(held, 1) - 1 AS INTEGER) AS idx, unnest(held) AS seq FROM h WHERE seq % 50 = 7""",
)
def _(spark, d):
    return state.flushed(an.frames(spark, d), F.col("seq") % 50 == 7)


@query(
    "o9_top_k",
    f"WITH {FRAMES} SELECT key, seq, elapsed FROM fr ORDER BY elapsed DESC, seq LIMIT 60",
)
def _(spark, d):
    return an.frames(spark, d).orderBy(F.desc("elapsed"), "seq").limit(60).select("key", "seq", "elapsed")


@query(
    "sk5_evaluation_log",
    f"""WITH {JUDGED} SELECT name AS file, status, CASE WHEN status <> 'ignored' THEN expected END AS expected, CASE WHEN status <> 'ignored' THEN classified END AS classified,
      CASE WHEN status <> 'ignored' THEN round(elapsed, 2) END AS elapsed FROM ju WHERE status <> 'unlabeled'""",
)
def _(spark, d):
    rows = _judged(spark, d).filter("status <> 'unlabeled'")
    lines = rows.select(F.to_json(evaluate.log_record()).alias("json"))
    back = F.from_json("json", "file string, status string, expected string, classified string, elapsed double").alias("r")
    return lines.select(back).select("r.*")


# ---- the stream, run over a written log ----------------------------------------------------------


def _streamed(spark, d, sink_of):
    """Run the command log through the stream, in four micro-batches with a restart before each, into sink_of(folder); returns the folder."""
    log = an.command_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    log = log.select("key", "ts", "seq", "kind", "result", "source", "flag")
    return feed.played(log, lambda stream, out: live.live(stream).writeStream.foreachBatch(sink_of(out)))


@query(
    "st1_stream_twin",
    f"""WITH {REPLAYED} SELECT key, seq, kind, CASE WHEN kind = 'frame' OR kind = 'report' THEN prev END AS prev, committed, changed, suspicious, emits FROM rp""",
)
def _(spark, d):
    plain = lambda path: lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
    rows = spark.read.schema(live.OUT).parquet(_streamed(spark, d, plain))
    prev = F.when(F.col("kind").isin("frame", "report"), F.col("prev"))
    return rows.select("key", "seq", "kind", prev.alias("prev"), "committed", "changed", "suspicious", "emits")


def _journal(spark, d):
    """The command log as requests, a JSON object a line: key, ts, seq, json."""
    kinds = {v: k for k, v in requests.ROUTES.items()} | {"frame": "/receive"}
    route = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("kind")]
    form = F.struct("result", "source", F.col("flag").cast("string").alias("flag"))
    rows = an.command_log(spark, d)
    own = F.struct(F.col("key").alias("client"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), F.col("seq").alias("n"), route.alias("route"), form.alias("form"), (F.col("kind") == "frame").alias("image"))
    return rows.select("key", "ts", "seq", F.to_json(own).alias("json"))


@query("sc12_sc13_request_stream", ORACLE["st1_stream_twin"])
def _(spark, d):
    """Requests in a journal that grows while the stream stands still, read by the source in small splits: the live state over them."""
    rows = _journal(spark, d)
    home = feed.folder(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [0.25, 0.5, 0.75])).first()[0] or []
    staged = rows.withColumn("part", sum(((at > c).cast("int") for c in cuts), F.lit(0)))
    # Every second part has lines that are no request, one of them half a line.
    noise = F.when((F.col("part") % 2 == 1) & (F.col("seq") % 97 == 0), F.concat(F.lit('{"client": 1, "route"\n\n'), "json")).otherwise(F.col("json"))
    staged.select("part", noise.alias("value")).write.partitionBy("part").text(f"{home}/staged")
    for i in range(len(cuts) + 1):
        feed.appended(spark, f"{home}/staged/part={i}", f"{home}/journal", f"part-{i}", ".jsonl")
        out = live.live(requests.log_rows(requests.read_requests(spark, f"{home}/journal", 1 << 20)))
        run = out.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(live.OUT).parquet(f"{home}/out")
    prev = F.when(F.col("kind").isin("frame", "report"), F.col("prev"))
    return rows.select("key", "seq", "kind", prev.alias("prev"), "committed", "changed", "suspicious", "emits")


@query("sk2_sk3_upserts", ORACLE["sk2_sk3_latest"])
def _(spark, d):
    """Four upserts by order of the log into a stored table, the last of them by a second writer after one that failed."""
    log = an.frames(spark, d).select("key", "seq", "result", F.when(F.col("seq") % 3 != 0, F.col("source")).alias("source"))
    home = feed.folder(spark)
    cuts = log.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75])).first()[0] or []
    part = sum(((F.col("seq") > c).cast("int") for c in cuts), F.lit(0))
    for i in range(len(cuts) + 1):
        store.Store(spark, home, "key long, result string, source string", ["key"]).upsert(log.filter(part == i), by="seq")
    return store.Store(spark, home, "key long, result string, source string", ["key"]).read()


@query(
    "sc14_overwritten",
    """SELECT strftime(ts, '%Y-%m-%d_%H-%M') || '.png' AS filename, max(event_id) AS event_id FROM events GROUP BY ALL""",
)
def _(spark, d):
    """Saves under names that repeat: the last one of a name stays, in two calls of which the second overwrites."""
    rows = table(spark, d, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd_HH-mm"), F.lit(".png")).alias("filename"), "event_id")
    saved = store.Store(spark, feed.folder(spark), "filename string, event_id long", ["filename"])
    last = rows.agg(F.max("event_id")).first()[0]
    for late in (False, True):
        saved.upsert(rows.filter((F.col("event_id") * 2 > F.lit(last)) == late).withColumn("at", F.col("event_id")), by="at")
    return saved.read()


@query(
    "sc11_live_overrides",
    f"""WITH {HASHES}, f AS (SELECT name, p, n, n % 4 AS part FROM hs), o AS (SELECT n AS pos, p, tag, (n // 40) % 4 AS part FROM hs WHERE n % 40 = 0),
    m AS (SELECT f.name, arg_min(o.tag, o.pos) AS label FROM f JOIN o ON o.part <= f.part AND hamming(f.p, o.p) <= 10 GROUP BY f.name)
    SELECT name, m.label FROM f LEFT JOIN m USING (name)""",
)
def _(spark, d):
    """Frames in four micro-batches; before each one more overrides are stored, which count from then on."""
    rows = _tagged(spark, d)
    frames = rows.select("name", "phash", (F.col("n") % 4).alias("part"))
    listed = rows.filter("n % 40 = 0").select(F.col("n").alias("pos"), "phash", F.col("tag").alias("label"), ((F.col("n") / 40).cast("long") % 4).alias("part"))
    home = feed.folder(spark)
    frames.write.partitionBy("part").parquet(f"{home}/staged")
    for i in range(4):
        overrides.store(spark, f"{home}/overrides").upsert(listed.filter(F.col("part") == i))
        feed.renamed(spark, f"{home}/staged/part={i}", f"{home}/log/part-{i}")
        stream = spark.readStream.schema("name string, phash long").parquet(f"{home}/log/*")
        run = stream.writeStream.foreachBatch(overrides.sink(f"{home}/overrides", f"{home}/out")).option("checkpointLocation", f"{home}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("name string, label string").parquet(f"{home}/out").select("name", "label")


@query(
    "sk7_sk8_carried_out",
    """WITH f AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN doc_id || '.png' WHEN 1 THEN doc_id || '.wav' ELSE 'compressed_' || doc_id || '.jpg' END AS name FROM documents),
    p AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'images/' WHEN 1 THEN 'audio/' ELSE 'thumbnails/' END AS dir FROM f)
    SELECT CASE WHEN doc_id % 10 = 3 THEN name WHEN doc_id % 7 <> 0 THEN dir || name END AS name, CASE WHEN doc_id % 10 = 3 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'moved' END AS outcome,
      md5(text) AS digest FROM p WHERE doc_id % 7 > 0 OR doc_id % 10 = 3
    UNION ALL SELECT NULL, 'deleted', NULL FROM p WHERE doc_id % 7 = 0 AND doc_id % 10 <> 3""",
)
def _(spark, d):
    """A file for each document: some are deleted, the others moved to the folder of their kind, but for those whose target is there. Half of the plan is carried out first, then all of it."""
    home = feed.folder(spark)
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 3
    name = F.when(kind == 0, F.concat(n, F.lit(".png"))).when(kind == 1, F.concat(n, F.lit(".wav"))).otherwise(F.concat(F.lit("compressed_"), n, F.lit(".jpg")))
    target = F.concat(F.when(kind == 0, "images/").when(kind == 1, "audio/").otherwise("thumbnails/"), name)
    taken = F.col("doc_id") % 10 == 3
    plan = table(spark, d, "documents").select("doc_id", "text", name.alias("src"), target.alias("target"), taken.alias("taken"))
    plan = plan.withColumn("dest", F.when((F.col("doc_id") % 7 > 0) | taken, F.col("target")))
    carry.put(plan.select("src", "text").unionByName(plan.filter("taken").select(F.col("target").alias("src"), F.lit("there").alias("text"))), home)
    carry.carried(plan.filter("doc_id % 2 = 0"), home, f"{home}-journal", apply=True)
    done = carry.carried(plan, home, f"{home}-journal", apply=True)
    at = F.when(F.col("outcome") == "moved", F.col("dest")).when(F.col("outcome") == "skipped", F.col("src"))
    left = files.contents_at(done.select(at.alias("at"), "outcome"), home, "at")
    return left.select(F.col("at").alias("name"), "outcome", F.md5("content").alias("digest"))


# ---- timers on the stream ------------------------------------------------------------------------

#: A row of no key of ours that comes after all others, so that the watermark passes every timer.
_LAST = -1


def _timed(rows, processor, columns):
    """Play rows (key, ts, seq, kind, status) to a processor, then a tick two days after the last day; the micros of columns as ts."""
    spark = rows.sparkSession
    timers.use_store(spark)
    end = F.date_trunc("day", F.max(F.col("ts").cast("timestamp"))) + F.expr("INTERVAL 2 DAYS") + F.expr("INTERVAL 1 SECOND")
    none = F.lit(None)
    tick = rows.agg(end.cast("timestamp_ntz").alias("ts")).select(
        F.lit(_LAST).cast("long").alias("key"), "ts", F.lit(0).cast("long").alias("seq"), F.lit("tick").alias("kind"), none.cast("string").alias("status")
    )
    path = feed.played(rows.unionByName(tick), lambda stream, out: timers.timed(stream, processor).writeStream.format("parquet").option("path", out))
    out = spark.read.schema(processor.OUT).parquet(path)
    return out.select(*[F.timestamp_micros(c).cast("timestamp_ntz").alias(columns[c]) if c in columns else F.col(c) for c in out.columns])


def _kinds(spark, d, kind, status=None):
    rows = an.frames(spark, d) if status is None else state.debounced(an.frames(spark, d))
    return rows.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", kind.alias("kind"), (F.lit(None).cast("string") if status is None else status).alias("status"))


@query("st8_stream_saves", ORACLE["st8_periodic_saves"])
def _(spark, d):
    return _timed(_kinds(spark, d, F.lit("frame")), timers.Saver(3600), {"saved_us": "saved_at"})


@query(
    "st9_in_flight",
    """WITH r AS (SELECT user_id AS key, ts, event_id AS seq, CASE WHEN event_id % 3 = 1 THEN 'switch' ELSE 'done' END AS kind FROM events WHERE event_id % 3 > 0),
    n AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS nt, lead(kind) OVER (PARTITION BY key ORDER BY ts, seq) AS nk FROM r),
    s AS (SELECT *, ts + INTERVAL 30 MINUTE AS lim FROM n WHERE kind = 'switch')
    SELECT key, ts, seq, TRUE AS in_flight, 'started' AS why FROM s
    UNION ALL SELECT key, lim, seq, FALSE, 'expired' FROM s WHERE nt IS NULL OR nt >= lim
    UNION ALL SELECT key, nt, seq, FALSE, 'acknowledged' FROM s WHERE nt < lim AND nk = 'done'""",
)
def _(spark, d):
    m = F.col("seq") % 3
    rows = _kinds(spark, d, F.when(m == 1, "switch").when(m == 2, "done")).filter("kind IS NOT NULL")
    return _timed(rows, timers.InFlight(1800), {"us": "ts"})


@query(
    "st10_sk10_status_feed",
    f"""WITH {DEBOUNCED}, e AS (SELECT date_trunc('day', max(ts)) + INTERVAL 2 DAY + INTERVAL 1 SECOND AS fin FROM events),
    c AS (SELECT key, ts, seq, coalesce(committed, '...') AS status, lag(coalesce(committed, '...')) OVER (PARTITION BY key ORDER BY ts, seq) AS was FROM db),
    g AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY key ORDER BY ts, seq), (SELECT fin FROM e)) AS until FROM c WHERE status IS DISTINCT FROM was)
    SELECT key, ts, 'change' AS message, status FROM g
    UNION ALL SELECT key, unnest(range(ts + INTERVAL 6 HOUR, until + INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)), 'keepalive', status FROM g""",
)
def _(spark, d):
    rows = _kinds(spark, d, F.lit("status"), F.coalesce("committed", F.lit("...")))
    return _timed(rows, timers.StatusFeed(6 * 3600), {"us": "ts"})


@query("sk9_stream_sink", ORACLE["sk9_switch_commands"])
def _(spark, d):
    path = _streamed(spark, d, lambda path: outputs.command_sink(SETTINGS, path))
    return spark.read.schema("key bigint, seq bigint, classification string, output string, input int").parquet(path).drop("batch")


from framewise.plans import catalog_files  # noqa: E402, F401  (registers its queries)
