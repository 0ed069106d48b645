"""Near-duplicate detection with DartMinHash signatures.

A text is a weighted set: its five-word shingles, weighted by how often they occur. Every unit of
weight of every element is a cell into which darts fall at random times, given by hashes, at a rate
of one in each unit of time (Christiani, 2020). A text throws the darts that fall into its cells
before a time at which it expects enough of them, gives each a coordinate by hash, and keeps the
earliest dart of each coordinate. Two texts agree in a coordinate with the probability of their
weighted Jaccard likeness, at a cost of one hash for each word and a few for each dart.

Texts that agree in a band of coordinates are candidates; links are exact likenesses of 0.8 or more.
Classes are connected components of links. Equal texts are one node from the start. Within a bucket
all nodes are held against the most central one, so a bucket of many copies makes as many comparisons
as it has nodes.

Nodes of buckets that are still apart are settled without pairing a bucket with itself. A shingle that
few of them hold is rare. What two texts share is at most their rare shingles in common and the lesser
of what else they hold; so pairs are counted through rare shingles alone, and most nodes hold too many
of those, unshared, to have another link at all. What is left goes on with a greater bound for rare.
At least one node of a pair lies outside its bucket's largest component, and only such nodes ask. No
step of these drops a pair that could be a link.

Where texts are made of so few parts that nothing is rare, counting would pair everything. Those texts
get a longer signature of the same kind: deep bands, each of three times as many coordinates, so that
texts that are only half alike no longer meet, and a sketch of further coordinates, one byte each, in
which pairs that meet must agree often enough before their texts are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm import textgrams as tg
from framewise.llm.common import mapped, text_or_empty, written

N_WORDS = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
#: A shingle in so many texts at most, of those that are still apart, is rare; level by level.
RARE = (16, 256, 4096)
#: Pairs that a level may count through shingles, for each shingle of the texts that are apart.
PAIRS_A_SHINGLE = 4
#: The longer signature: bands of coordinates (a pair at LEAST is in none of them four times in ten
#: thousand), coordinates of the sketch, and in how many of those a pair must agree (one at LEAST agrees
#: in 819 of 1,024 in the mean, four standard deviations above that: three in a hundred thousand are missed).
DEEP_BANDS, DEEP_ROWS = 220, 15
SKETCH, AGREE = 1024, 768
#: Texts whose darts are thrown at once for it.
DEEP_TEXTS = 16
U = np.uint64


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> U(11)).astype(float) + 1) / 2.0**53


def darts(cells: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts that fall into each cell before the time given for it: index of the cell, time, hash of the dart.

    Times between darts are exponential, from the hash of cell and number, so a longer look sees the
    same darts and more.
    """
    at, when, which = [], [], []
    alive, time, n = np.arange(len(cells)), np.zeros(len(cells)), 0
    with np.errstate(over="ignore"):
        while len(alive):
            n += 1
            h = tg.mix(cells[alive] + U(n) * U(0x9E3779B97F4A7C15))
            time = time - np.log(_unit(h))
            ok = time < until[alive]
            alive, time = alive[ok], time[ok]
            at.append(alive)
            when.append(time)
            which.append(tg.mix(h[ok] ^ U(0xA5A5A5A5A5A5A5A5)))
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (at, when, which))


def signatures(hashes: np.ndarray, doc: np.ndarray, weights: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """An n_docs by k matrix of dart hashes from distinct elements (hash, index of text, weight > 0); 0s for empty sets."""
    out = np.zeros((n_docs, k), U)
    units = np.ceil(weights).astype(np.int64)
    cell_doc = np.repeat(doc, units)
    number = np.arange(len(cell_doc)) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        cells = tg.mix(np.repeat(hashes, units) + number.astype(U) * U(0xC2B2AE3D27D4EB4F))
    share = np.minimum(1.0, np.repeat(weights, units) - number)  # of the unit that is the element's
    total = np.bincount(cell_doc, weights=share, minlength=n_docs)
    look = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    left = np.flatnonzero(total > 0)
    while len(left):
        mine = np.isin(cell_doc, left) if len(left) < n_docs else np.ones(len(cell_doc), bool)
        c, d, s = cells[mine], cell_doc[mine], share[mine]
        at, when, which = darts(c, look[d])
        inside = _unit(tg.mix(which ^ U(0x5DEECE66D))) <= s[at]
        at, when, which = at[inside], when[inside], which[inside]
        slot = d[at] * k + (tg.mix(which ^ U(0x2545F4914F6CDD1D)) % U(k)).astype(np.int64)
        order = np.lexsort((when, slot))
        slot, which = slot[order], which[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = which[first]
        full = np.bincount(slot[first] // k, minlength=n_docs) == k
        left = left[~full[left]]
        look[left] *= 2  # some coordinate has no dart yet
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    part = signature[:, : bands * rows].reshape(-1, bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15) + np.zeros((len(part), bands), U)
        for j in range(rows):
            key = tg.mix(key ^ part[:, :, j])
    return key.view(np.int64)


def weighted_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of texts: first and last text, and shingle hashes, indices of texts, counts."""
    data, starts = tg.flat(texts)
    for a, b in tg.chunks(starts):
        yield a, b, *tg.shingle_counts(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], N_WORDS)


def signed(rows: DataFrame, text_col: str) -> DataFrame:
    """rows without their text, with hash (MD5 of the text), weight (number of shingles) and keys (one for each band; none if there is no word)."""
    keep = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = tg.columns(batch)
            texts = c[text_col]
            keys, weight = [], []
            for a, b, h, doc, n in weighted_sets(texts):
                sig = signatures(h, doc, n.astype(float), b - a, BANDS * ROWS)
                w = np.bincount(doc, weights=n, minlength=b - a).astype(np.int64)
                keys += [k if x else [] for k, x in zip(band_keys(sig, BANDS, ROWS).tolist(), w, strict=True)]
                weight.append(w)
            hashes = [hashlib.md5((t.as_py() or "").encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [c[x] for x in keep] + [pa.array(hashes, pa.string()), pa.array(np.concatenate(weight) if weight else [], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*keep, "hash", "weight", "keys"],
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(rows, run, f"{kinds}, hash string, weight long, keys array<long>")


def deep_signed(texts: DataFrame) -> DataFrame:
    """node, keys (of deep bands) and sketch (binary) of texts (node, text); texts without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column(0))
            for a, b, h, doc, n in weighted_sets(batch.column(1)):
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                for x in range(0, b - a, DEEP_TEXTS):
                    y = min(b - a, x + DEEP_TEXTS)
                    part = slice(cut[x], cut[y])
                    sig = signatures(h[part], doc[part] - x, n[part].astype(float), y - x, DEEP_BANDS * DEEP_ROWS + SKETCH)
                    some = np.flatnonzero(np.diff(cut[x : y + 1]) > 0)
                    keys = band_keys(sig[some], DEEP_BANDS, DEEP_ROWS)
                    sketch = (sig[some][:, DEEP_BANDS * DEEP_ROWS :] & U(255)).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[a + x + some], pa.int64()), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array([r.tobytes() for r in sketch], pa.binary())],
                        names=["node", "keys", "sketch"],
                    )

    return mapped(texts.select("node", "text"), run, "node long, keys array<long>, sketch binary")


def agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches agree in AGREE coordinates or more."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            su, sv = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
            ok = pa.array((su == sv).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    return mapped(both, run, "u long, v long")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two sets (ascending hashes, weights): sum of minima by sum of maxima."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    either = float(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are alike enough. Both sides of the join by node are split by AQE if a node is in many pairs."""
    both = (
        pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
        .join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
        .select("u", "v", "tu", "tv")
    )

    def sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for a, b, h, doc, n in weighted_sets(pa.array(texts, pa.string())):
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            out += [(h[x:y], n[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                u, v = np.asarray(part.column(0)), np.asarray(part.column(1))
                new = [i for i in np.unique(u, return_index=True)[1] if int(u[i]) not in known]
                last = known.get(int(u[0]))
                known = {int(u[0]): last} if last is not None else {}
                new += [i for i in np.unique(u, return_index=True)[1] if int(u[i]) not in known and i not in new]
                for i, s in zip(new, sets([part.column(2)[int(i)].as_py() for i in new]), strict=True):
                    known[int(u[i])] = s
                ok = [likeness(known[int(x)], s) >= LEAST for x, s in zip(u, sets(part.column(3).to_pylist()), strict=True)]
                known = {int(u[-1]): known[int(u[-1])]}
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], names=["u", "v"])

    return mapped(both, run, "u long, v long")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """node, shingle, n (times it occurs) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, h, doc, n in weighted_sets(batch.column(1)):
                node = np.asarray(batch.column(0))[a + doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["node", "shingle", "n"]
                )

    return mapped(texts.select("node", "text"), run, "node long, shingle long, n int")


def _linkable(shared: Column, wu: str = "wu", wv: str = "wv") -> Column:
    """Whether texts of these weights that share so much are alike enough: s / (wu + wv - s) >= LEAST."""
    return shared * (1 + LEAST) >= LEAST * (F.col(wu) + F.col(wv)) - 1e-6


def left_pairs(pool: DataFrame, texts: DataFrame, rare: tuple[int, ...] = RARE) -> DataFrame:
    """Distinct pairs (u, v) that may still be links, from the nodes whose buckets hold several components.

    pool: node, comp, weight, asks (whether the node is outside the largest
    component of one of them). At each level a shingle in rare[level] nodes at most is rare, and rest
    is a node's weight without rare shingles: no more can be shared by two nodes that have no rare
    shingle in common. Pairs that have one are counted here in full and decided; the others go on to
    the next level, or, if that would count too many pairs, meet in deep bands.
    """
    rows = written(shingle_rows(texts.join(pool.select("node"), "node", "left_semi")), "dup-shingles")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("node"), F.max("n").alias("n"))
    held = written(held.filter(F.col("held") <= rare[-1]), "dup-held")
    several = rows.join(held.filter("held > 1").select("shingle", "held"), "shingle")
    alone = held.filter("held = 1").select("node", "shingle", "n", "held")
    level = [F.sum(F.when(F.col("held") <= most, F.col("n")).otherwise(0)).alias(f"rare{i}") for i, most in enumerate((1, *rare))]
    own = several.select("node", "shingle", "n", "held").unionByName(alone).groupBy("node").agg(*level)
    rest = [(F.col("weight") - F.coalesce(f"rare{i}", F.lit(0))).alias(f"rest{i}") for i in range(len(rare) + 1)]
    nodes = written(pool.join(own, "node", "left").select("node", "comp", "weight", "asks", *rest), "dup-left")
    size = rows.count()

    def side(df: DataFrame, x: str, i: int, *more: str) -> DataFrame:
        """Columns of the nodes that can have a link at level i, named for one side of a pair."""
        on = df.filter(F.col(f"rest{i}") >= LEAST * F.col("weight") - 1e-6)
        on = on.filter("asks") if x == "u" else on
        names = {"node": x, "comp": f"c{x}", "weight": f"w{x}", "asks": f"a{x}", "n": f"n{x}", f"rest{i}": f"r{x}", f"rest{i + 1}": f"s{x}"}
        return on.select(*more, *[F.col(a).alias(b) for a, b in names.items() if a in on.columns])

    # Each pair once: from the node that asks or, if both do, from the lesser one.
    once = (F.col("cu") != F.col("cv")) & (~F.col("av") | (F.col("u") < F.col("v"))) & _linkable(F.least("ru", "rv"))
    found, done = [], 0
    met = several.join(nodes, "node").filter(F.col("rest0") >= LEAST * F.col("weight") - 1e-6)
    met = written(met, "dup-met")
    for i, most in enumerate(rare):
        some = met.filter((F.col("held") <= most) & (F.col("held") > (rare[i - 1] if i else 1)))
        asked = some.filter(F.col("asks") & (F.col(f"rest{i}") >= LEAST * F.col("weight") - 1e-6)).agg(F.sum("held")).first()[0] or 0
        if asked > PAIRS_A_SHINGLE * size:
            break
        done = i + 1
        if not asked:
            continue
        pairs = side(some, "u", i, "shingle").join(side(some, "v", i, "shingle"), "shingle").filter(once)
        told = pairs.groupBy("u", "v").agg(F.sum(F.least("nu", "nv")).alias("both"), *[F.first(c).alias(c) for c in ("wu", "wv", "su", "sv")])
        found.append(written(told.filter(_linkable(F.col("both") + F.least("su", "sv"))).select("u", "v"), "dup-pairs"))
    # What is left meets in deep bands; each node there is one row a band, whatever its bucket holds.
    left = nodes.filter(F.col(f"rest{done}") >= LEAST * F.col("weight") - 1e-6)
    if not left.filter("asks").isEmpty():
        deep = written(deep_signed(texts.join(left.select("node"), "node", "left_semi")), "dup-deep")
        left = left.join(deep.select("node", F.explode("keys").alias("key")), "node")
        left = written(left, "dup-bands")
        met = side(left, "u", done, "key").join(side(left, "v", done, "key"), "key").filter(once).select("u", "v").distinct()
        found.append(written(agreeing(written(met, "dup-met"), deep.select("node", "sketch")), "dup-pairs"))
    return reduce(DataFrame.unionByName, found).distinct() if found else pool.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the least node) for all nodes of edges (u, v).

    Each round gives every node the least label around it and then its label's label; the tables
    hold a row for each node or edge, minima combine before the shuffle.
    """
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "dup-edges")
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("comp")), "dup-labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("v"), F.col("comp").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        best = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "other").alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = written(best.join(up, "comp").select("node", "old", F.least("comp", "up").alias("comp")), "dup-labels")
        label = new.select("node", "comp")
        if new.filter("comp <> old").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with its class.

    Returns id_col, the columns keep, class_id (the least id_col in the class; a class whose ids are
    all null has null), first (1 for one row of each class: the least id, then any), class_rows, and
    n_links (links of the row's text to different texts that were looked at and found; a class needs
    and finds fewer than there are).
    Null texts count as empty; texts without a word are alike only if they are equal; repeated rows
    are one class; very long texts are compared whole; an empty table gives no rows; other columns are
    not read. A link is lost if no band of its signatures agrees: four in ten thousand at a likeness of
    0.8, fewer above; where deep bands decide, as many again.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), *keep, text_or_empty(text_col).alias("text")
    )
    rows = written(signed(rows, "text"), "dup-signed")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    nodes = rows.groupBy("hash").agg(F.min(key).alias("lead"), F.first("keys").alias("keys"), F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n_rows"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")

    spread = nodes.select("node", "weight", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(spread.join(shared, "key"), "dup-buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "hash", F.col("lead.id").alias("id"))
    # One row of each text comes along: that of the node's least id (of repeated rows any).
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.md5("text"))
    texts = own.join(wanted, (own["hash"] == wanted["hash"]) & own["id"].eqNullSafe(wanted["id"])).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]) if _repeats(rows) else texts, "dup-texts")

    # First every node against the most central one of each of its buckets.
    central = buckets.groupBy("node").agg(F.sum("n").alias("c"))
    heads = buckets.join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node", "weight")).alias("h"))
    pairs = buckets.join(heads, "key").select(F.col("h.node").alias("u"), F.col("node").alias("v"), F.col("h.weight").alias("wu"), F.col("weight").alias("wv"))
    edges = written(linked(_possible(pairs), texts), "dup-links")
    label = components(edges)

    # Then what is still apart within a bucket.
    at = buckets.join(label, "node", "left").select("key", "node", "weight", F.coalesce("comp", "node").alias("comp"))
    parts = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    apart = at.join(top.select("key", F.col("top.comp").alias("most")), "key")
    pool = apart.groupBy("node").agg(F.first("comp").alias("comp"), F.first("weight").alias("weight"), F.max(F.col("comp") != F.col("most")).alias("asks"))
    pool = written(pool, "dup-apart")
    if not pool.isEmpty():
        more = written(linked(left_pairs(pool, texts), texts), "dup-links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            label = components(edges)
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
    links = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))

    lead = nodes.join(label, "node", "left").join(links, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "n_links": F.coalesce("n_links", F.lit(0))})
    firsts = lead.groupBy("comp").agg(F.min("lead").alias("first"), F.sum("n_rows").alias("class_rows"))
    told = lead.select("hash", "comp", "n_links").join(firsts, "comp").select("hash", "first", "class_rows", "n_links")
    return rows.join(told, "hash").select(
        F.col("id").alias(id_col), *keep, F.col("first.id").alias("class_id"), (F.col("first.rid") == F.col("rid")).cast("int").alias("first"), "class_rows", "n_links"
    )


def _possible(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of different nodes; likeness is at most the lesser weight by the greater."""
    return pairs.filter((F.col("u") != F.col("v")) & (F.least("wu", "wv") >= LEAST * F.greatest("wu", "wv"))).select("u", "v").distinct()


def _repeats(rows: DataFrame) -> bool:
    """Whether an id occurs twice with one text."""
    return not rows.groupBy("id", "hash").count().filter("count > 1").isEmpty()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of docs, same columns, whatever their names: that of the least id.

    Null ids come after all others; null and empty texts are one class; of repeated rows one stays; very
    long texts are compared whole; an empty table gives no rows.
    """
    rows = written(docs.withColumn("_fw_row", F.monotonically_increasing_id()), "dup-rows")
    told = classes(rows, id_col, text_col, keep=("_fw_row",)).filter("first = 1").select("_fw_row")
    return rows.join(told, "_fw_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
