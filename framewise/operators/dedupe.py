"""Exact and near duplicates among frames, label conflicts, overrides, and what follows from them.

Hash rows have name, size, phash, dhash, and pos (place in the order of keeping: protected frames
first, then chronological). Pairs within a distance come from blocks of hashes, of which each two are
compared by a task; band keys would make more candidates than an exclusive or of 64 bits is worth,
nearly all pairs at a distance of 16. Equal hashes are one row there and in all that follows from it,
so a frame that is repeated a million times makes no pairs with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions import bits, names
from framewise.plans.persist import stored

THRESHOLD = 10
DHASH_SLACK = 4
# Hashes of frames that are nearly black.
BLANK = (0x0, 0x80)
MOST_ROUNDS = 10_000
#: Hashes of a block, of which a task compares two; pairs of hashes compared at once.
BLOCK, AT_ONCE = 1 << 14, 1 << 14
#: Rows of a group of near hashes that one task decides in order; larger groups go by rounds.
LOCAL = 5000
#: Rounds after which the tables of decided rows become one.
MERGE_EACH = 8


def exact_groups(files: DataFrame) -> DataFrame:
    """Groups of equal content (name, pos, content): the digest, how many, and the first one, which stays."""
    n = F.count(F.lit(1))
    return files.groupBy(F.md5("content").alias("digest")).agg(n.alias("n"), F.min_by("name", "pos").alias("keep")).filter("n > 1")


def hash_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b, distance) of distinct hashes within threshold, both orders, each hash with itself too.

    Every two blocks are one group, so a task holds two blocks, and a hash is sent once for each block.
    """
    own = stored(hashes.select("phash").distinct().filter("phash IS NOT NULL"))
    n = max(1, -(-own.count() // BLOCK))
    block = F.pmod(F.xxhash64("phash"), F.lit(n)).cast("int")
    met = own.select("phash", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    met = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "phash")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        block, values = t["block"].to_numpy(), t["phash"].to_numpy().view(np.uint64)
        left, right = values[block == i], values[block == j]
        step = max(1, AT_ONCE // max(1, len(right)))
        # The same memory for all steps.
        xor, count = np.empty((step, len(right)), np.uint64), np.empty((step, len(right)), np.uint8)
        for k in range(0, len(left), step):
            m = len(left[k : k + step])
            np.bitwise_xor(left[k : k + m, None], right[None, :], out=xor[:m])
            d = np.bitwise_count(xor[:m], out=count[:m]).reshape(-1)
            hit = np.flatnonzero(d <= threshold)
            if len(hit):
                a, b, d = left[k + hit // len(right)].view(np.int64), right[hit % len(right)].view(np.int64), d[hit].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "distance"])
                if i < j:
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.array(d)], names=["a", "b", "distance"])

    return met.repartition(n * (n + 1), "i", "j").groupBy("i", "j").applyInArrow(near, "a long, b long, distance int")


def conflicts(hashes: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Labelled frames within threshold whose labels differ, `ignore` included: name_a, label_a, name_b, label_b, distance, nearest first."""
    known = hashes.join(labels.filter("label IS NOT NULL"), "name").select("name", "label", "phash", "pos")
    # A hash with its label is one row while hashes are paired: frames of one hash and label never meet each other.
    kinds = stored(known.select("phash", "label").distinct())
    one = lambda x: kinds.select(F.col("label").alias(f"label_{x}"), F.col("phash").alias(x))
    pairs = hash_pairs(kinds, threshold).join(one("a"), "a").join(one("b"), "b").filter("label_a <> label_b")
    side = lambda x: known.select(*[F.col(c).alias(f"{c}_{x}") for c in ("name", "label", "pos")], F.col("phash").alias(x))
    pairs = pairs.join(side("a"), ["a", "label_a"]).join(side("b"), ["b", "label_b"])
    return pairs.filter(F.col("pos_a") < F.col("pos_b")).select("name_a", "label_a", "name_b", "label_b", "distance").orderBy("distance", "name_a", "name_b")


def ordered(hashes: DataFrame, protected: DataFrame) -> DataFrame:
    """hashes (name, …) with protected and pos: protected frames first, then by time."""
    marked = hashes.join(protected.select("name", F.lit(True).alias("protected")), "name", "left")
    marked = marked.withColumn("protected", F.coalesce("protected", F.lit(False)))
    # A struct that orders as the keeping does; comparing it needs no global numbering.
    key = F.struct((~F.col("protected")).alias("free"), names.taken(F.col("name")).isNull().alias("late"), names.taken(F.col("name")).alias("at"), "name")
    return marked.withColumn("pos", key)


class _Growing:
    """A table that grows by stored parts, which become one each MERGE_EACH parts."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > MERGE_EACH:
            self.parts = [stored(self.table().coalesce(64))]

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def grouped(pairs: DataFrame) -> DataFrame:
    """phash and group (the least hash in it) of the hashes in pairs (a, b; both orders), by connection.

    Each round gives a hash the least label around it, and then that label's label.
    """
    label = stored(pairs.groupBy(F.col("a").alias("phash")).agg(F.least(F.min("a"), F.min("b")).alias("group")))
    for _ in range(MOST_ROUNDS):
        near = pairs.join(label.select(F.col("phash").alias("b"), "group"), "b").groupBy(F.col("a").alias("phash")).agg(F.min("group").alias("near"))
        best = label.join(near, "phash").select("phash", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        up = label.select(F.col("phash").alias("group"), F.col("group").alias("up"))
        new = stored(best.join(up, "group").select("phash", "old", F.least("group", "up").alias("group")))
        label = new.select("phash", "group")
        if new.filter("old <> `group`").isEmpty():
            return label
    raise RuntimeError(f"groups did not settle in {MOST_ROUNDS} rounds")


def decided_in_order(rows: DataFrame, threshold: int, use_dhash: bool) -> DataFrame:
    """The greedy pass of each group (rows with group), row by row in order of pos: name, kept, representative, distance.

    A task takes its groups from one sorted stream, as most have a few rows only.
    """

    def decide(part: pd.DataFrame) -> list[tuple]:
        phash, dhash = part["phash"].to_numpy().view(np.uint64), part["dhash"].to_numpy().view(np.uint64)
        free, name = ~part["protected"].to_numpy(bool), part["name"].to_numpy()
        cuts = np.flatnonzero(np.diff(part["group"].to_numpy())) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
            firsts = np.zeros(b - a, np.int64)  # the first kept row of each hash, in order
            n, seen = 0, set()
            for i in range(a, b):
                near = None
                if n:
                    d = np.bitwise_count(phash[firsts[:n]] ^ phash[i])
                    j = int(d.argmin())
                    far = use_dhash and int(np.bitwise_count(dhash[firsts[j]] ^ dhash[i])) > threshold + DHASH_SLACK
                    near = (firsts[j], int(d[j])) if d[j] <= threshold and free[i] and not far else None
                if near is None and phash[i] not in seen:
                    seen.add(phash[i])
                    firsts[n] = i
                    n += 1
                out.append((name[i], near is None, None if near is None else name[near[0]], None if near is None else near[1]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = lambda out: pd.DataFrame(out, columns=["name", "kept", "representative", "distance"]).astype({"distance": "Int32"})
        held: list[pd.DataFrame] = []
        for part in batches:
            if not len(part):
                continue
            # The last group may go on in the next batch.
            held.append(part)
            if held[0]["group"].iat[0] == part["group"].iat[-1]:
                continue
            rows = pd.concat(held)
            open_ = (rows["group"] == rows["group"].iat[-1]).to_numpy()
            held = [rows[open_]]
            yield told(decide(rows[~open_]))
        if held:
            yield told(decide(pd.concat(held)))

    spark = rows.sparkSession
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "pos").drop("pos")
    return dealt.mapInPandas(run, "name string, kept boolean, representative string, distance int")


def kept_first(hashes: DataFrame, threshold: int = THRESHOLD, use_dhash: bool = True) -> DataFrame:
    """The greedy pass in rounds: name, kept, representative, distance for every row.

    Rows (name, phash, dhash, protected, pos) are taken in order of pos. A row goes if its nearest
    kept predecessor (ties: the earliest) is within threshold, unless it is protected or the two
    dhashes differ too much; then it stays, and the second nearest is not tried.

    Of the kept rows of one phash only the first matters to others. Groups of hashes that are connected
    by near pairs have nothing to do with each other; one of LOCAL rows at most is decided in order by
    one task. In larger groups a round looks, for each open row, at the near phashes whose kept row, or
    first open row, comes before it. Those no farther than the nearest kept one may be what decides; if
    they all would let the row go, or all let it stay, it does, whatever becomes of them. Else it waits.
    Of the rows of one phash those before the first that stays or waits are settled. Rows behind the
    first kept one of their own phash are decided all at once in the end,
    and representatives are looked up then. A round's tables hold open rows and their pairs, and are stored.
    """
    rows = stored(hashes.select("name", "phash", "dhash", "protected", "pos"))
    pairs = stored(hash_pairs(rows, threshold).filter("a <> b"))
    group = grouped(pairs)
    sizes = rows.join(group, "phash").groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= LOCAL)
    small = stored(group.join(sizes, "group").select("phash", "group"))
    local = decided_in_order(rows.join(small, "phash"), threshold, use_dhash)
    rows = stored(rows.join(small, "phash", "left_anti"))
    pairs = stored(pairs.join(small.select(F.col("phash").alias("a")), "a", "left_anti"))
    far = lambda other: bits.distance(F.col("dhash"), F.col(other)) > threshold + DHASH_SLACK if use_dhash else F.lit(False)
    # Hashes without pairs need no rounds: their first row stays.
    first = lambda part: part.groupBy(F.col("phash").alias("k_phash")).agg(F.min(F.struct("pos", "name", "dhash")).alias("k")).select("k_phash", F.col("k.pos").alias("k_pos"), F.col("k.name").alias("k_name"), F.col("k.dhash").alias("k_dhash"))
    paired = pairs.select(F.col("a").alias("phash")).distinct()
    alone, known, dropped = stored(first(rows.join(paired, "phash", "left_anti"))), _Growing(), _Growing()
    known.add(alone.limit(0))
    dropped.add(rows.limit(0))
    left, open_pairs = stored(rows.join(paired, "phash", "left_semi")), pairs
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        # The dhash of what a phash may keep, if its open rows agree on it.
        dhash = F.when(F.min("dhash") == F.max("dhash"), F.min("dhash")).alias("k_dhash")
        ahead = left.groupBy(F.col("phash").alias("b")).agg(F.min("pos").alias("at"), dhash).withColumn("is_kept", F.lit(False))
        ahead = ahead.unionByName(known.table().select(F.col("k_phash").alias("b"), F.col("k_pos").alias("at"), "k_dhash", F.lit(True).alias("is_kept")))
        near = left.join(open_pairs.join(ahead, "b").select(F.col("a").alias("phash"), "distance", "at", "k_dhash", "is_kept"), "phash").filter(F.col("at") < F.col("pos"))
        key, is_far = F.struct("distance", "at"), far("k_dhash")
        nearest = lambda which: F.min(F.when(F.coalesce(which, F.lit(True)), key))
        near = near.groupBy("name").agg(nearest(F.col("is_kept")).alias("held"), nearest(is_far).alias("may_stay"), nearest(~is_far).alias("may_go"))
        goes = F.col("held").isNotNull() & (F.col("may_stay").isNull() | (F.col("may_stay") > F.col("held")))
        stays = F.col("protected") | F.col("may_go").isNull() | F.coalesce(F.col("may_go") > F.col("held"), F.lit(False))
        told = left.join(near, "name", "left").select(*left.columns, F.when(stays, "stays").when(goes, "goes").otherwise("waits").alias("told"))
        told = stored(told)
        stop = told.filter("told <> 'goes'").groupBy("phash").agg(F.min(F.struct("pos", "told", "name", "dhash")).alias("s"))
        stop = stored(stop)
        new = stop.filter("s.told = 'stays'").select(F.col("phash").alias("k_phash"), F.col("s.pos").alias("k_pos"), F.col("s.name").alias("k_name"), F.col("s.dhash").alias("k_dhash"))
        known.add(stored(new))
        told = told.join(stop.select("phash", F.col("s.pos").alias("stop"), (F.col("s.told") == "stays").alias("held")), "phash", "left")
        dropped.add(stored(told.filter("told = 'goes'").filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).select(*left.columns)))
        left = stored(told.filter(~F.col("held") & (F.col("pos") >= F.col("stop"))).select(*left.columns))
        open_pairs = stored(open_pairs.join(left.select(F.col("phash").alias("a")).distinct(), "a", "left_semi"))
    else:
        raise RuntimeError(f"not decided in {MOST_ROUNDS} rounds")
    kept = stored(known.table())
    nearest = dropped.table().join(pairs.withColumnRenamed("a", "phash"), "phash").join(kept, F.col("b") == F.col("k_phash")).filter(F.col("k_pos") < F.col("pos"))
    nearest = nearest.groupBy("name").agg(F.min(F.struct("distance", "k_pos", "k_name")).alias("n"))
    gone = nearest.select("name", F.lit(False).alias("kept"), F.col("n.k_name").alias("representative"), F.col("n.distance").alias("distance"))
    own = rows.join(kept.unionByName(alone).withColumnRenamed("k_phash", "phash"), "phash").filter(F.col("pos") >= F.col("k_pos"))
    keep = (F.col("pos") == F.col("k_pos")) | F.col("protected") | F.coalesce(far("k_dhash"), F.lit(False))
    own = own.select("name", keep.alias("kept"), F.when(~keep, F.col("k_name")).alias("representative"), F.when(~keep, F.lit(0)).alias("distance"))
    return own.unionByName(gone).unionByName(local)


def clusters(hashes: DataFrame, threshold: int) -> DataFrame:
    """Leader clusters (leader, name, distance): each row not yet taken leads and takes the later ones near it.

    A row belongs to its earliest near leader. Rows of one phash have the same leader, so its first row
    is decided and speaks for them. Who leads is found in rounds: a row leads once no open row is near
    before it, and all near rows behind a leader are taken, whatever else is before them. Which leader
    takes a row is looked up in the end.
    """
    every = hashes.select("name", "phash", "pos")
    first = every.groupBy("phash").agg(F.min(F.struct("pos", "name")).alias("f"))
    rows = stored(first.select(F.col("f.name").alias("name"), "phash", F.col("f.pos").alias("pos")))
    earlier = rows.select(F.col("name").alias("e_name"), F.col("phash").alias("b"), F.col("pos").alias("e_pos"))
    pairs = hash_pairs(rows, threshold).join(rows.withColumnRenamed("phash", "a"), "a").join(earlier, "b").filter(F.col("e_pos") < F.col("pos"))
    pairs = stored(pairs.select("name", "e_name", "e_pos", "distance"))
    left = pairs.select("name", "e_name")
    leads = stored(rows.select("name").join(left.select("name").distinct(), "name", "left_anti"))
    taken = _Growing()
    for _ in range(MOST_ROUNDS):
        # Those behind the leaders found last, and what is still open without them.
        new = stored(left.join(leads.select(F.col("name").alias("e_name")), "e_name", "left_semi").select("name").distinct())
        taken.add(new)
        rest = stored(left.join(new, "name", "left_anti"))
        if rest.isEmpty():
            break
        open_rows = rest.select("name").distinct()
        left = stored(rest.join(new.select(F.col("name").alias("e_name")), "e_name", "left_anti"))
        leads = stored(open_rows.join(left.select("name").distinct(), "name", "left_anti"))
    else:
        raise RuntimeError(f"not decided in {MOST_ROUNDS} rounds")
    gone = stored(taken.table())
    # All earlier near rows that were not taken lead.
    told = pairs.join(gone.select(F.col("name").alias("e_name")), "e_name", "left_anti").join(gone, "name", "left_semi")
    told = told.groupBy("name").agg(F.min(F.struct("e_pos", "e_name", "distance")).alias("f")).select("name", "f.e_name", "f.distance")
    by_hash = rows.join(told, "name", "left").select("phash", F.coalesce("e_name", "name").alias("leader"), F.coalesce("distance", F.lit(0)).alias("distance"))
    return every.join(by_hash, "phash").select("leader", "name", "distance")


def report(files: DataFrame, hashes: DataFrame, threshold: int) -> DataFrame:
    """Both passes as JSON texts (kind, json): exact groups by digest, then near clusters among one of each digest."""
    exact = exact_groups(files)
    firsts = files.groupBy(F.md5("content").alias("digest")).agg(F.min_by("name", "pos").alias("name")).select("name")
    near = clusters(hashes.join(firsts, "name", "left_semi"), threshold).filter("leader <> name")
    return exact.select(F.lit("exact").alias("kind"), F.to_json(F.struct("digest", "n", "keep")).alias("json")).unionByName(
        near.select(F.lit("near").alias("kind"), F.to_json(F.struct("leader", "name", "distance")).alias("json"))
    )


def protected(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Names that carry manual work: with a label that is not null, or with features."""
    return labels.filter("label IS NOT NULL").select("name").union(features.select("name")).distinct()


def removals(decided: DataFrame, hashes: DataFrame, keep: DataFrame) -> DataFrame:
    """Names to remove and why: near duplicates, and blank frames that are not protected and not among those."""
    doomed = decided.filter("NOT kept").select("name")
    blank = hashes.filter(F.col("phash").isin(*BLANK)).select("name").join(keep, "name", "left_anti")
    return doomed.withColumn("why", F.lit("duplicate")).unionByName(blank.subtract(doomed).withColumn("why", F.lit("blank")))


def reclaimed(removed: DataFrame, media: DataFrame) -> DataFrame:
    """Files and bytes per medium (frames by name, others by stem: name, medium, size) and their share of all of it."""
    stems = removed.select(names.stem(F.col("name")).alias("stem"), F.lit(True).alias("gone")).distinct()
    rows = media.withColumn("stem", names.stem(F.col("name"))).join(stems, "stem", "left")
    gone = F.coalesce("gone", F.lit(False))
    out = rows.groupBy("medium").agg(F.count_if(gone).alias("n"), F.sum(F.when(gone, F.col("size")).otherwise(0)).alias("bytes"), F.sum("size").alias("total"))
    return out.select("medium", "n", "bytes", F.round(100.0 * F.try_divide("bytes", "total"), 1).alias("percent"))


def pruned(metadata: DataFrame, removed: DataFrame) -> DataFrame:
    """metadata without the removed names; rows without a name (lines that could not be read) stay."""
    return metadata.join(removed.select("name").distinct(), "name", "left_anti")


def distances(decided: DataFrame) -> DataFrame:
    return decided.filter("NOT kept").groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def overridden(frames: DataFrame, overrides: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """name and the label of the first override (in order of insertion, not the nearest) within threshold; null if none.

    Overrides (pos, phash, label) are added by hand; the join is by band keys all the same.
    """
    listed = overrides.groupBy("phash").agg(F.min(F.struct("pos", "label")).alias("o"))
    bands = bits.band_plan(threshold)
    left = frames.select("phash").distinct().select("phash", F.explode(bits.band_keys(F.col("phash"), bands, near=False)).alias("k"))
    right = listed.select(F.col("phash").alias("p"), "o", F.explode(bits.band_keys(F.col("phash"), bands, near=True)).alias("k"))
    hit = left.join(right, "k").filter(bits.distance(F.col("phash"), F.col("p")) <= threshold).groupBy("phash").agg(F.min("o").alias("o"))
    return frames.join(hit, "phash", "left").select("name", F.col("o.label").alias("label"))


def flagged(items: DataFrame, held: DataFrame) -> DataFrame:
    """Overrides from flagged items (n, ts, label, phash): the first held frame (ts, seq) of that time; `ignore` and items without phash are skipped."""
    want = items.filter("label <> 'ignore' AND phash")
    first = held.withColumn("r", F.row_number().over(W.partitionBy("ts").orderBy("seq"))).filter("r = 1").select("ts", "seq")
    return want.join(first, "ts").select("n", "seq", "label")
