"""Clusters of vectors: leader clustering and its merge, classification, density clustering, reports, k-means."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine, l2


def top_by(rows: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


#: Products of two clusters' vectors held at once.
PRODUCTS = 4_000_000


class _Cluster:
    """Tags with their counts; the center is the first of the most frequent and is kept up to date."""

    def __init__(self) -> None:
        self.tags: dict[str, int] = {}
        self.place: dict[str, int] = {}
        self.count = 0
        self.top: str | None = None

    def add(self, tag: str, n: int = 1) -> None:
        self.place.setdefault(tag, len(self.tags))
        self.tags[tag] = self.tags.get(tag, 0) + n
        self.count += n
        if self.top is None or (self.tags[tag], -self.place[tag]) > (self.tags[self.top], -self.place[self.top]):
            self.top = tag

    def center(self) -> str:
        return self.top


def leader_clusters(pool: DataFrame, affinity: float = 0.7, min_count: int = 3, every: int = 1000, seed_twice: bool = True) -> DataFrame:
    """(rank, count, center, tags) of pool(seq, tag, vec), grown in the order of seq; tags without a vector must be left out before.

    A tag whose closeness to some cluster is exactly 0 is passed over; else it joins the first cluster of the greatest
    closeness (1 for a member, else the cosine to the center) above affinity, or founds one.  Small clusters are pruned
    every `every` tags and at the end, then clusters merge whose tags are alike often enough.  The order decides the
    result, so one task does it: the pool is made of the few tags of each burst, not of the texts.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        vectors = {}
        for t, v in zip(pdf["tag"], pdf["vec"]):
            v = np.asarray(v, float)
            vectors[t] = v / (np.linalg.norm(v) or 1.0)
        clusters: list[_Cluster] = []
        least, accepted = min_count, 0
        centers = np.empty((1024, len(next(iter(vectors.values()), ()))))
        holders: dict[str, list[int]] = {}  # the places of the clusters a tag is a member of

        def prune():
            nonlocal clusters, least
            clusters = [c for c in clusters if c.count > least]
            holders.clear()
            for i, c in enumerate(clusters):
                centers[i] = vectors[c.center()]
                for t in c.tags:
                    holders.setdefault(t, []).append(i)

        def join(i: int, tag: str) -> None:
            nonlocal centers
            if i == len(clusters):
                clusters.append(_Cluster())
                if i == len(centers):
                    centers = np.concatenate([centers, np.empty_like(centers)])
            if tag not in clusters[i].tags:
                holders.setdefault(tag, []).append(i)
            clusters[i].add(tag)
            centers[i] = vectors[clusters[i].center()]

        tags = list(pdf["tag"])
        if tags and seed_twice:
            join(0, tags[0])
        for tag in tags:
            mine = holders.get(tag, [])
            near = centers[: len(clusters)] @ vectors[tag]
            near[mine] = 1.0
            exact = lambda i: 1.0 if i in mine else float(vectors[clusters[i].center()] @ vectors[tag])
            # products of all centers at once may differ in the last place, so what decides is told by single ones
            if any(exact(i) == 0 for i in np.flatnonzero(np.abs(near) < 1e-9)):
                continue
            best = near.max(initial=-np.inf)
            told = [(exact(i), -i) for i in np.flatnonzero(near >= best - 1e-9)]
            top = max(told, default=(-np.inf, 0))
            join(-int(top[1]) if top[0] > affinity else len(clusters), tag)
            accepted += 1
            if accepted % every == 0:
                prune()
                least += 1
        prune()
        clusters = _merge(clusters, vectors, affinity)
        clusters.sort(key=lambda c: -c.count)
        return pd.DataFrame([(i + 1, c.count, c.center(), sorted(c.tags, key=lambda t: -c.tags[t])) for i, c in enumerate(clusters)], columns=["rank", "count", "center", "tags"])

    return pool.select("seq", "tag", "vec", F.lit(1).alias("one")).groupBy("one").applyInPandas(grow, "rank long, count long, center string, tags array<string>")


def _merge(clusters: list[_Cluster], vectors: dict[str, np.ndarray], affinity: float) -> list[_Cluster]:
    """The head meets the others in turn and merges with the first that shares enough alike pairs, or goes to the back."""
    def rows(c: _Cluster) -> np.ndarray:
        return np.stack([vectors[t] for t in c.tags])

    queue, budget = [(c, rows(c)) for c in clusters], len(clusters)
    while budget > 0 and queue:
        (head, mine), rest = queue[0], queue[1:]
        for i, (other, theirs) in enumerate(rest):
            # piece by piece, so that memory does not grow with the product of both
            step = max(1, PRODUCTS // len(theirs))
            alike = sum(int(np.count_nonzero(mine[k : k + step] @ theirs.T >= affinity)) for k in range(0, len(mine), step)) / (len(mine) * len(theirs))
            if alike >= affinity / 2:
                both = _Cluster()
                for part in (head, other):
                    for t, n in part.tags.items():
                        both.add(t, n)
                queue = [*rest[:i], *rest[i + 1 :], (both, rows(both))]
                budget -= 2
                break
        else:
            queue = [*rest, (head, mine)]
            budget -= 1
    return [c for c, _ in queue]


def classify(tags: DataFrame, clusters: DataFrame, key: str = "doc_id", least: float = 0.7, heads: int = 5, few: int = 10_000) -> DataFrame:
    """(key, clusters): the distinct clusters that the tags(key, vec) vote for; (0, others) without a vote.

    clusters(rank, center, vecs) hold the vectors of their first tags.  A tag votes for the first cluster of the greatest
    cosine, if that is at least `least`.  Clusters are sent to the tags where they are `few` at most, which are counted first;
    more of them meet the tags block by block.
    """
    told = clusters.select("rank", "center", F.slice("vecs", 1, heads).alias("vecs"))
    if told.limit(few + 1).count() <= few:
        told = F.broadcast(told)
    met = tags.crossJoin(told).withColumn("sim", F.array_max(F.transform("vecs", lambda v: F.round(cosine(F.col("vec"), v), 9))))
    votes = met.groupBy(key, "tag").agg(F.max_by(F.struct(F.col("rank").alias("num"), "center"), F.struct("sim", -F.col("rank"))).alias("c"), F.max("sim").alias("sim"))
    chosen = votes.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("sim") >= least, F.col("c")))).alias("clusters"))
    others = F.array(F.struct(F.lit(0).cast("long").alias("num"), F.lit("others").alias("center")))
    return chosen.withColumn("clusters", F.when(F.size("clusters") > 0, F.col("clusters")).otherwise(others))


#: Points of a tile: a task compares two blocks tile against tile.  Blocks have as many points at least, and more where there would
#: be more than MOST of them: each point is sent once for each block, so what is sent grows with the points, not with their square.
BLOCK, MOST = 1024, 16


def _blocks(points: DataFrame) -> int:
    return max(1, min(MOST, -(-points.count() // BLOCK)))


def _paired(points: DataFrame, blocks: int) -> DataFrame:
    """points(id, ...) in every pair (p, q) of blocks, p <= q, that theirs is part of: side 0 in p, side 1 in q, a block with
    itself once."""
    dealt = points.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    first = dealt.withColumn("q", F.explode(F.sequence("own", F.lit(blocks - 1).cast("long")))).withColumnRenamed("own", "p").withColumn("side", F.lit(0))
    second = dealt.where("own > 0").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))).withColumnRenamed("own", "q").withColumn("side", F.lit(1))
    both = first.unionByName(second).withColumn("pair", (F.col("q") * (F.col("q") + 1) / 2).cast("long") + F.col("p"))
    return both if blocks == 1 else both.repartition(blocks * (blocks + 1), "pair")  # by number, so that parts are not put together


def _squares(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all of w."""
    out = v @ w.T
    out *= -2
    out += np.square(v).sum(1)[:, None]
    out += np.square(w).sum(1)[None, :]
    return out


def _compare(points: DataFrame, blocks: int, eps: float, schema: str, meet) -> DataFrame:
    """What meet(a, b, tiles, same) gives for each pair of blocks: the rows of both, and (i, j, near) of their tiles with their
    first rows and which of them lie at most eps apart; of a block with itself those with i <= j alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = not len(b) and int(pdf["p"].iloc[0]) == int(pdf["q"].iloc[0])
        b = a if same else b
        if not len(a) or not len(b):
            return meet(a, b, (), same)
        x = np.stack(a["vec"]).astype(float)
        y = x if same else np.stack(b["vec"]).astype(float)

        def tiles():
            for i in range(0, len(x), BLOCK):
                for j in range(i if same else 0, len(y), BLOCK):
                    v, w = x[i : i + BLOCK], y[j : j + BLOCK]
                    square = _squares(v, w)
                    k, m = np.nonzero(np.abs(square - eps * eps) < 1e-9 * (1 + eps * eps))  # where rounding could decide, the differences do
                    square[k, m] = np.square(v[k] - w[m]).sum(1)
                    yield i, j, square <= eps * eps

        return meet(a, b, tiles(), same)

    return _paired(points, blocks).groupBy("pair").applyInPandas(run, schema)


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, label) of points(id, vec): density clusters by Euclidean distance, -1 for noise.

    Labels follow the clusters' smallest core id; a border point takes the first cluster that reaches it.  All points meet,
    block against block inside tasks, which give counts of neighbours, then links that unite core points, then what border
    points are reached by, never the pairs themselves.  Labels spread by minima along those links, each round checkpointed,
    until none changes.
    """
    points = points.select("id", "vec")
    blocks = _blocks(points)

    def count(a, b, tiles, same):
        m, n = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for i, j, near in tiles:
            m[i : i + len(near)] += near.sum(1)
            if not same or i < j:
                (m if same else n)[j : j + near.shape[1]] += near.sum(0)
        parts = [(a["id"], m)] if same else [(a["id"], m), (b["id"], n)]
        return pd.DataFrame({"id": np.concatenate([i for i, _ in parts]).astype("int64"), "n": np.concatenate([n for _, n in parts]).astype("int64")})

    def unite(a, b, tiles, same):
        ids, edges = (a["id"] if same else pd.concat([a["id"], b["id"]])).to_numpy(), []
        root, off = np.arange(len(ids)), 0 if same else len(a)
        for i, j, near in tiles:
            left, right = root[i : i + len(near)], root[off + j : off + j + near.shape[1]]
            k, m = np.nonzero(near & (left[:, None] != right[None, :]))
            if not len(k):
                continue
            up: dict[int, int] = {}

            def find(x):
                while x in up:
                    x = up[x]
                return x

            for x, y in np.unique(np.stack([left[k], right[m]], 1), axis=0).tolist():
                x, y = find(x), find(y)
                if x != y:
                    edges.append((ids[x], ids[y]))
                    up[max(x, y)] = min(x, y)
            to = np.arange(len(ids))
            to[list(up)] = [find(x) for x in up]
            root = to[root]
        return pd.DataFrame(edges, columns=["id", "other"], dtype="int64")

    def reach(a, b, tiles, same):
        none = np.iinfo(np.int64).max
        x, y = a["num"].to_numpy(), b["num"].to_numpy()
        m, n = np.full(len(a), none), np.full(len(b), none)

        def lowest(least, at, mine, others, near):
            border, core = np.flatnonzero(mine < 0), np.flatnonzero(others >= 0)
            if len(border) and len(core):
                least[at + border] = np.minimum(least[at + border], np.where(near[np.ix_(border, core)], others[core], none).min(1))

        for i, j, near in tiles:
            p, q = x[i : i + len(near)], y[j : j + near.shape[1]]
            lowest(m, i, p, q, near)
            if not same or i < j:
                lowest(m if same else n, j, q, p, near.T)
        parts = [(a["id"].to_numpy(), m)] if same else [(a["id"].to_numpy(), m), (b["id"].to_numpy(), n)]
        return pd.concat([pd.DataFrame({"id": i[r < none], "reach": r[r < none]}) for i, r in parts])

    core = _compare(points, blocks, eps, "id long, n long", count).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id").checkpoint()
    spanning = _compare(points.join(core, "id"), blocks, eps, "id long, other long", unite)
    links = spanning.union(spanning.select("other", "id")).union(core.select("id", F.col("id").alias("other"))).distinct().checkpoint()
    label = core.select("id", F.col("id").alias("label"))
    while True:
        lowest = links.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("label"))
        jumped = lowest.join(label.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.least("label", "up").alias("label")).checkpoint()
        changed = jumped.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        label = jumped
        if not changed:
            break
    order = label.select("label").distinct().withColumn("num", F.dense_rank().over(Window.orderBy("label")).cast("long") - 1)  # a row a cluster
    numbered = points.join(label.join(order, "label").select("id", "num"), "id", "left").withColumn("num", F.coalesce("num", F.lit(-1))).checkpoint()
    reached = _compare(numbered, blocks, eps, "id long, reach long", reach).groupBy("id").agg(F.min("reach").alias("reach"))
    return numbered.select("id", "num").join(reached, "id", "left").select("id", F.when(F.col("num") >= 0, F.col("num")).otherwise(F.coalesce("reach", F.lit(-1))).alias("label"))


def cluster_report(members: DataFrame, show: int = 5) -> DataFrame:
    """(label, size, mean_n, medoid, nearest) of members(label, id, n, vec): the members nearest to the mean vector, nearest first."""
    each = members.select("label", "id", F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    mean = each.groupBy("label", "pos").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    far = members.join(mean, "label").withColumn("dist", F.round(l2("vec", "mean"), 9))
    ranked = far.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("dist", "id")))
    tops = ranked.groupBy("label").agg(
        F.count("*").alias("size"), F.round(F.avg("n"), 6).alias("mean_n"), F.min_by("id", "r").alias("medoid"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= show, F.struct("r", "id")))), lambda s: s["id"]).alias("nearest"),
    )
    return tops


def kmeans(features: DataFrame, columns: Sequence[str], k: int = 6, seed: int = 21) -> DataFrame:
    """features with the label of k-means over the columns scaled by their population deviation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    stats = features.agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(F.stddev_pop(c).alias(f"{c}_s") for c in columns))
    scaled = features.crossJoin(F.broadcast(stats)).withColumns({f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_m"), f"{c}_s"), F.lit(0.0)) for c in columns})
    ready = VectorAssembler(inputCols=[f"{c}_z" for c in columns], outputCol="_v").transform(scaled)
    out = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="label").fit(ready).transform(ready)
    return out.select(*features.columns, "label", *(f"{c}_z" for c in columns))


def silhouette(points: DataFrame) -> DataFrame:
    """(id, label, s) of points(id, vec, label): with a the mean distance to the others of its label and b the least mean distance
    to those of another, s is (b - a) / max(a, b); 0 for a point alone in its label or without other labels.

    Blocks of points meet inside tasks, tile against tile, which give a sum of distances for each point and label.
    """
    points = points.select("id", "vec", F.col("label").cast("long").alias("label"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = not len(b) and int(pdf["p"].iloc[0]) == int(pdf["q"].iloc[0])
        out = []
        if len(a) and (same or len(b)):
            a = a.sort_values("label", kind="stable")
            b = a if same else b.sort_values("label", kind="stable")
            v = np.stack(a["vec"]).astype(float)
            w = v if same else np.stack(b["vec"]).astype(float)
            (la, na), (lb, nb) = (np.unique(x["label"], return_inverse=True) for x in (a, b))
            m, n = np.zeros((len(a), len(lb))), np.zeros((len(b), len(la)))

            def add(total, far, which):  # rows are sorted by label, so each label's are side by side
                first = np.flatnonzero(np.diff(which, prepend=-1))
                total[:, which[first]] += np.add.reduceat(far, first, axis=1)

            for i in range(0, len(v), BLOCK):
                for j in range(i if same else 0, len(w), BLOCK):
                    far = np.sqrt(np.maximum(_squares(v[i : i + BLOCK], w[j : j + BLOCK]), 0))
                    if same and i == j:
                        np.fill_diagonal(far, 0)
                    add(m[i : i + BLOCK], far, nb[j : j + BLOCK])
                    if not same or i < j:
                        add((m if same else n)[j : j + BLOCK], far.T, na[i : i + BLOCK])
            for x, labels, which, total in ((a, lb, nb, m),) if same else ((a, lb, nb, m), (b, la, na, n)):
                n = np.broadcast_to(np.bincount(which), (len(x), len(labels))) - same * (x["label"].to_numpy()[:, None] == labels)
                out.append(pd.DataFrame({"id": np.repeat(x["id"].to_numpy(), len(labels)), "other": np.tile(labels, len(x)), "total": total.ravel(), "n": n.ravel().astype(float)}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["id", "other", "total", "n"])

    met = _paired(points, _blocks(points)).groupBy("pair").applyInPandas(sums, "id long, other long, total double, n double")
    means = met.groupBy("id", "other").agg((F.try_divide(F.sum("total"), F.sum("n"))).alias("mean")).join(points.select("id", "label"), "id")
    own = F.col("other") == F.col("label")
    both = means.groupBy("id", "label").agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"))
    return both.select("id", "label", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("s"))


def run_name(pool: str, affinity: float, model: str) -> str:
    """The name of a clustering: its pool, the digits of its affinity and its model."""
    return f"{pool}_{str(affinity).replace('.', '')}{model}"


def label_stats(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, maximum and minimum of the columns by label."""
    return labelled.groupBy("label").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min))))
