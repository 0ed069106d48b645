"""Secret scans with corpus-wide ownership frequency.

Candidates are what the base patterns match and bare tokens that look random. Their hashes are
counted over the whole corpus by distinct repositories and owners. A value that several owners hold,
or that lies in many repositories whoever owns them, is a widely copied example; a value that looks
random and is neither is taken for a live credential of its owner, and its bare occurrences become
spans of kind `live`.

Only DataFrame expressions. Counting is a distinct over (hash, owner, repository), then sums that
combine before the shuffle, so a value held by a third of all rows loads no task; the join that
brings verdicts back has one row a hash on its one side, and AQE splits the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import match_spans, prefixes, replaced, text_or_empty, written

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BARE = r"[A-Za-z0-9+/_=-]{20,}"
#: A value that so many owners hold, or that is in so many repositories, is a widely copied example.
MANY_OWNERS, MANY_REPOS = 3, 20

_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, value) by start, then kind."""

    def kind(name: str, rank: int, pattern: str, least: int, group: int = 0) -> Column:
        # The short hexadecimal runs of ordinary prose are passed over with the gaps.
        spans = F.filter(match_spans(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(
            spans,
            lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["end"], F.lit(name).alias("kind"), m["value"]),
        )

    long_hex = r"[0-9a-f]{24,}"
    return F.array_sort(
        F.concat(kind("assign", 0, ASSIGN, 6, 2), kind("access", 1, ACCESS, 20), kind("hex", 2, long_hex, 24)).cast(_SPANS)
    )


def looks_random(value: Column) -> Column:
    """At least three digits, three letters and ten different characters."""
    return (
        (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 3)
        & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 3)
        & (F.size(F.array_distinct(F.split(value, ""))) >= 10)
    )


def bare_spans(text: Column, base: Column) -> Column:
    """Bare tokens that look random and lie outside the base spans.

    In one list by start, a token is outside if no base span before it ends after its start and the
    next one starts after its end (tokens do not overlap each other).
    """
    found = F.filter(match_spans(text, BARE), lambda m: looks_random(m["value"]))
    live = F.transform(found, lambda m: F.struct(m["start"], F.lit(3).alias("rank"), m["end"], F.lit("live").alias("kind"), m["value"])).cast(_SPANS)

    def outside(both: Column) -> Column:
        ends = prefixes(F.transform(both, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        after = F.transform(F.slice(both, F.lit(2), F.size(both)), lambda s: s["start"])
        free = F.filter(
            F.arrays_zip(both.alias("s"), ends.alias("e"), after.alias("n")),
            lambda z: (z["s"]["rank"] == 3) & (z["e"] <= z["s"]["start"]) & (z["n"].isNull() | (z["n"] >= z["s"]["end"])),
        )
        return F.transform(free, lambda z: z["s"])

    # The search for tokens is written once, so that it runs once.
    listed = lambda found: F.transform(F.array(F.array_sort(F.concat(base, found))), outside)[0]
    return F.transform(F.array(live), lambda found: F.when(F.size(found) > 0, listed(found)).otherwise(found))[0]


def ownership(candidates: DataFrame) -> DataFrame:
    """n_repos, n_owners, example and live of each hash, from columns hash, owner, repo, random.

    A repository is one of its owner. Nulls among owners or repositories count as one owner or repository.
    """
    held = candidates.groupBy("hash", "owner", "repo").agg(F.max("random").alias("random"))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("random").alias("random"))
    counts = by_owner.groupBy("hash").agg(
        F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("random").alias("random")
    )
    example = (F.col("n_owners") >= MANY_OWNERS) | (F.col("n_repos") >= MANY_REPOS)
    return counts.select("hash", "n_repos", "n_owners", example.alias("example"), (F.col("random") & ~example).alias("live"))


def marked(docs: DataFrame, keep: list[str], text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """The columns keep of every row, with _fw_base and _fw_marks.

    _fw_marks holds (start, rank, end, kind, value, live, example, n_owners, n_repos) of every base and bare
    span, by start and kind. Rows without a candidate, most of them, take no part in a shuffle.
    """
    text = text_or_empty(text_col)
    rows = (
        docs.select(
            *[F.col(f"`{c}`") for c in keep],
            F.monotonically_increasing_id().alias("_fw_rid"),
            F.col(owner_col).alias("_fw_owner"),
            F.col(repo_col).cast("string").alias("_fw_repo"),
            text.alias("_fw_text"),
        )
        .withColumn("_fw_base", base_spans(F.col("_fw_text")))
        .withColumn("_fw_all", F.concat("_fw_base", bare_spans(F.col("_fw_text"), F.col("_fw_base"))))
        .drop("_fw_text")
    )
    rows = written(rows, "secret-rows")
    hits = rows.filter(F.size("_fw_all") > 0)
    spans = hits.select("_fw_rid", "_fw_owner", "_fw_repo", F.explode("_fw_all").alias("s")).withColumn("hash", F.md5("s.value"))
    verdicts = ownership(
        spans.select("hash", F.col("_fw_owner").alias("owner"), F.col("_fw_repo").alias("repo"), looks_random(F.col("s.value")).alias("random"))
    )
    told = F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value", "live", "example", "n_owners", "n_repos")
    marks = (
        spans.join(verdicts, "hash")
        .groupBy("_fw_rid")
        .agg(F.array_sort(F.collect_list(told)).alias("_fw_marks"))
    )
    hits = hits.join(marks, "_fw_rid")
    rest = rows.filter(F.size("_fw_all") == 0).withColumn("_fw_marks", F.lit(None).cast(hits.schema["_fw_marks"].dataType))
    return hits.unionByName(rest).select(
        *[F.col(f"`{c}`") for c in keep], "_fw_base", F.coalesce("_fw_marks", F.array().cast(hits.schema["_fw_marks"].dataType)).alias("_fw_marks")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id"
) -> DataFrame:
    """Spans and verdicts of every row's whole text.

    Returns id_col, n_assign, n_access, n_hex, base_sha256, spans (base spans and those of kind
    live), n_live, the numbers of base spans whose value is taken for live or for a copied example,
    and the most owners and repositories of a value that is not a bare example (0: no such value).
    Null texts count as empty, null ids, owners and repositories are one each, repeated rows are rows
    of their own but one repository, very long texts are read whole, an empty table gives no rows;
    other columns are not read.
    """
    rows = marked(docs, [id_col], text_col, owner_col, repo_col)
    base, marks = F.col("_fw_base"), F.col("_fw_marks")
    spans = F.filter(marks, lambda m: (m["rank"] < 3) | m["live"])
    count = lambda which, test: F.size(F.filter(which, test)).cast("long")
    of_kind = lambda k: count(base, lambda s: s["kind"] == k)
    return rows.select(
        id_col,
        *[of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        count(marks, lambda m: (m["rank"] == 3) & m["live"]).alias("n_live"),
        count(marks, lambda m: (m["rank"] < 3) & m["live"]).alias("n_base_live"),
        count(marks, lambda m: (m["rank"] < 3) & m["example"]).alias("n_base_example"),
        *[F.coalesce(F.array_max(F.transform(spans, lambda m: m[n])), F.lit(0)).cast("long").alias(f"most_{n[2:]}") for n in ("n_owners", "n_repos")],
    )


def redacted(
    docs: DataFrame,
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    length_col: str | None = "n_chars",
    put: str = "<SECRET>",
) -> DataFrame:
    """docs, same columns, with every secret replaced; widely copied examples stay.

    length_col, if given, gets the new length in code points. Texts without a secret, null and empty
    ones too, stay as they are; null owners and repositories are one each; repeated rows come out
    equal, each for itself; very long texts are read whole; an empty table gives no rows; other
    columns, whatever their names, come along unchanged.
    """
    rows = marked(docs, docs.columns, text_col, owner_col, repo_col)
    secret = F.filter("_fw_marks", lambda m: m["live"] | ((m["rank"] < 3) & ~m["example"]))
    puts = F.transform(secret, lambda m: F.struct(m["start"], m["end"], F.lit(put).alias("put")))
    new = F.when(F.size(secret) > 0, replaced(F.col(f"`{text_col}`"), puts)).otherwise(F.col(f"`{text_col}`"))
    rows = rows.withColumn("_fw_hit", F.size(secret) > 0).withColumn(text_col, new)
    if length_col:
        length = F.when(F.col("_fw_hit"), F.length(F.col(f"`{text_col}`"))).otherwise(F.col(f"`{length_col}`"))
        rows = rows.withColumn(length_col, length.cast(docs.schema[length_col].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB twin of scanned() over documents.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
p(kind, rank, least, pat, grp) AS (VALUES
  ('assign', 0, 6, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  ('access', 1, 20, 'AKIA[A-Z0-9]+', 0),
  ('hex', 2, 24, '[0-9a-f]+', 0),
  ('live', 3, 20, '[A-Za-z0-9+/_=-]{20,}', 0)),
m AS (
  SELECT doc_id, source, kind, rank, least, regexp_extract_all(t, '(?s)' || pat) AS ms,
         CASE WHEN grp = 2 THEN regexp_extract_all(t, '(?s)' || pat, 2) ELSE regexp_extract_all(t, '(?s)' || pat) END AS vs,
         string_split_regex(t, '(?s)' || pat) AS gs
  FROM d, p
), e AS (
  SELECT doc_id, source, kind, rank, least, unnest(ms) AS mv, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM m
), s AS (
  SELECT doc_id, source, kind, rank, least, v,
         sum(length(g) + length(mv)) OVER w AS e, sum(length(g) + length(mv)) OVER w - length(mv) AS b
  FROM e WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)
), r AS (
  SELECT *, length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 3
            AND len(list_distinct(string_split(v, ''))) >= 10 AS random
  FROM s WHERE length(v) >= least
), c AS (
  SELECT * FROM r WHERE rank < 3
  UNION ALL
  SELECT * FROM r WHERE rank = 3 AND random
     AND NOT EXISTS (SELECT 1 FROM r AS o WHERE o.doc_id = r.doc_id AND o.rank < 3 AND o.b < r.e AND r.b < o.e)
), o AS (
  SELECT v, count(DISTINCT coalesce(source, '<null>')) AS n_owners, count(DISTINCT (source, doc_id)) AS n_repos, bool_or(random) AS random FROM c GROUP BY v
), f AS (
  SELECT c.*, n_owners, n_repos, n_owners >= 3 OR n_repos >= 20 AS example, o.random AND n_owners < 3 AND n_repos < 20 AS live FROM c JOIN o USING (v)
), g AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3), '') AS base,
    coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3 OR live), '') AS spans,
    count(*) FILTER (rank = 3 AND live) AS n_live, count(*) FILTER (rank < 3 AND live) AS n_base_live,
    count(*) FILTER (rank < 3 AND example) AS n_base_example,
    max(n_owners) FILTER (rank < 3 OR live) AS most_owners, max(n_repos) FILTER (rank < 3 OR live) AS most_repos
  FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_base_live, 0) AS n_base_live, coalesce(n_base_example, 0) AS n_base_example,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN g USING (doc_id)
"""
