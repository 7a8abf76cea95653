"""Clusters, itemsets, statistics, change points and influence over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import changepoint, cluster, embed, influence, itemsets, report
from ..operators import series as S
from ..sources import sinks
from ..sources.tables import table
from . import series_queries as SQ
from .text_queries import _words, docs


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """The distinct brands of each order."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))


def census(spark: SparkSession, d: str) -> DataFrame:
    """(track_id, flag, cluster, n): parts as tracks, orders as bursts, ship modes by supplier as clusters."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("track_id"), F.col("l_orderkey").alias("flag"), (F.col("l_suppkey") % 7).cast("string").alias("cluster"), F.col("l_quantity").cast("long").alias("q"))


def kinds(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT cluster, kind FROM VALUES ('0', 'event'), ('1', 'topic'), ('2', 'event'), ('3', 'topic'), ('4', 'topic') AS t(cluster, kind)")


def _lonely(spark, d):
    lone = report.lonely(table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderpriority").alias("cluster"))).where("lonely")
    return report.value_counts(lone).withColumn("density", F.round("density", 6))


def _share(spark, d):
    return report.event_topic_share(census(spark, d).groupBy("cluster").agg(F.count("*").alias("n")), kinds(spark))


def _focus(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("flag"), F.col("o_orderstatus").alias("cluster"))
    return report.focus_clusters(rows)


def _bands(spark, d):
    rows = table(spark, d, "orders").select(F.floor(F.col("o_totalprice") / 20).cast("long").alias("n"), F.concat(F.lit("c"), F.col("o_custkey") % 12).alias("cluster"))
    return report.bands(rows)


def _power_rows(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("x"))
    return per.select(F.col("l_returnflag").alias("key"), "x")


def _items(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "+") for c in columns})


def _pool(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), F.concat(F.lit("t"), "vec_id").alias("tag"), F.col("embedding").alias("vec"))


def _leaders(spark, d):
    return cluster.leader_clusters(_pool(spark, d), 0.25, 1)


def _listing(spark, d):
    return sinks.cluster_listing(_leaders(spark, d))


def _heads(spark, d):
    e = table(spark, d, "embeddings").where("vec_id < 30")
    return e.groupBy((F.col("vec_id") % 6 + 1).alias("rank")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("vecs")).withColumn("center", F.concat(F.lit("c"), "rank"))


def _classify(spark, d):
    tags = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("doc_id"), F.concat(F.lit("t"), "vec_id").alias("tag"), F.col("embedding").alias("vec"))
    got = cluster.classify(tags, _heads(spark, d), least=0.25)
    return got.select("doc_id", F.array_join(F.transform("clusters", lambda c: F.concat_ws(":", c["num"].cast("string"), c["center"])), "|").alias("clusters"))


#: Of the test tables' vectors of length 1, some in a hundred pairs are as near.
EPS = 1.15


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _checkpointed(spark: SparkSession) -> None:
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="engine-checkpoints-"))


def _dbscan(spark, d):
    _checkpointed(spark)
    return cluster.dbscan(_points(spark, d), EPS, 5)


def _cluster_report(spark, d):
    members = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), (F.col("vec_id") % 9).alias("n"), F.col("embedding").alias("vec"))
    return _items(cluster.cluster_report(members).withColumn("nearest", F.transform("nearest", lambda x: x.cast("string"))), "nearest")


def _kmeans(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return cluster.kmeans(rows, ["c_acctbal", "nation"], 6)


def _label_stats(spark, d):
    got = cluster.label_stats(table(spark, d, "customer").select(F.col("c_nationkey").alias("label"), "c_acctbal"), ["c_acctbal"])
    return got.withColumns({c: F.round(c, 4) for c in got.columns if c.startswith("c_acctbal")})


def _model(spark, d):
    rows = docs(spark, d).select("doc_id", _words().alias("words"))
    return embed.train_words(rows, size=16, least=20, rounds=1), rows


def _prices(spark, d):
    """The prices of each brand's parts in the order of their numbers, which rise: events and orders keep their pace throughout."""
    parts = table(spark, d, "part")
    return parts.select(F.col("p_brand").alias("key"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("idx"), F.col("p_retailprice").alias("y"))


def _windows(spark, d):
    return S.influence_windows(SQ._extents(spark, d).where("y >= 9"), SQ.hourly(spark, d), 20)


def _rules(spark, d, most=None):
    found = itemsets.frequent(itemsets.transactions(baskets(spark, d)), 40)
    return _items(itemsets.rules(found.where(F.size("items") <= most) if most else found, 0.05).withColumn("confidence", F.round("confidence", 6)), "antecedent", "consequent")


QUERIES = {
    "cluster_value_counts": lambda s, d: report.value_counts(census(s, d)).withColumn("density", F.round("density", 6)),
    "lonely_share": _lonely,
    "event_topic_share": _share,
    "focus_clusters": _focus,
    "has_cluster": lambda s, d: census(s, d).groupBy("track_id").agg(F.array_sort(F.collect_set("cluster")).alias("c")).where(F.array_contains("c", "3")).select("track_id", F.array_join("c", ",").alias("clusters")),
    "rank_bands": lambda s, d: _bands(s, d).groupBy("band").agg(F.count("*").alias("n")),
    "rank_band_counts": lambda s, d: report.band_counts(_bands(s, d)),
    "rank_share_pivot": lambda s, d: report.band_shares(_bands(s, d).groupBy("band", "cluster").agg(F.count("*").alias("n"))),
    "power_law_fit": lambda s, d: report.power_law(_power_rows(s, d)),
    "power_law_mle": lambda s, d: report.power_law_mle(_power_rows(s, d)),
    "transactions": lambda s, d: _items(itemsets.transactions(baskets(s, d)), "items"),
    "frequent_itemsets": lambda s, d: _items(itemsets.frequent(itemsets.transactions(baskets(s, d)), 40).where("size(items) <= 2"), "items"),
    "itemset_report": lambda s, d: _items(itemsets.report(itemsets.frequent(itemsets.transactions(baskets(s, d)), 40)).where("size(items) = 2"), "items"),
    "frequent_itemsets_all": lambda s, d: _items(itemsets.frequent(itemsets.transactions(baskets(s, d)), 40), "items"),
    "itemset_report_all": lambda s, d: _items(itemsets.report(itemsets.frequent(itemsets.transactions(baskets(s, d)), 40)), "items"),
    "frequent_pairs": lambda s, d: itemsets.pairs(baskets(s, d), 3),
    "association_rules": lambda s, d: _rules(s, d, 3),
    "association_rules_all": _rules,
    "leader_clusters": lambda s, d: _items(_leaders(s, d), "tags"),
    "cluster_listing": _listing,
    "classify_tags": _classify,
    "dbscan": _dbscan,
    "cluster_report": _cluster_report,
    "kmeans_second_level": _kmeans,
    "cluster_label_stats": _label_stats,
    "silhouette": lambda s, d: cluster.silhouette(_points(s, d)).withColumn("s", F.round("s", 6)),
    "cpd_pelt": lambda s, d: changepoint.pelt(_prices(s, d)),
    "cpd_binseg": lambda s, d: changepoint.binary_segmentation(SQ.daily(s, d)),
    "cpd_dynp": lambda s, d: changepoint.dynamic(SQ.hourly(s, d)),
    "garch_influence": lambda s, d: influence.garch(_windows(s, d)),
    "influence_significant": lambda s, d: influence.significant(influence.garch(_windows(s, d)), 0.2, 0.7),  # loose, as the events keep their pace
    "word2vec_synonyms": lambda s, d: embed.synonyms(_model(s, d)[0], "this"),
    "doc_vectors": lambda s, d: (lambda v: embed.nearest_documents(v, v.where("doc_id = 1")))(embed.document_vectors(*_model(s, d))),
}
_B = """b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT l_orderkey, list_sort(list(p_brand)) AS items FROM b GROUP BY 1), t AS (SELECT DISTINCT items FROM s), u AS (SELECT row_number() OVER () AS id, items FROM t), i AS (SELECT id, unnest(items) AS item FROM u),
f1 AS (SELECT item AS items, count(*) AS freq FROM i GROUP BY 1 HAVING count(*) >= 40), f2 AS (SELECT a.item AS a, b.item AS b, count(*) AS freq FROM i a JOIN i b ON a.id = b.id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 40),
f3 AS (SELECT a.item AS a, b.item AS b, c.item AS c, count(*) AS freq FROM i a JOIN i b ON a.id = b.id AND a.item < b.item JOIN i c ON c.id = b.id AND b.item < c.item GROUP BY ALL HAVING count(*) >= 40)"""
#: Every subset of every transaction by bit masks, so that sets have any size.
_ALL = """b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT DISTINCT items FROM (SELECT list_sort(list(p_brand)) AS items FROM b GROUP BY l_orderkey)), m AS (SELECT items, unnest(range(1, (1::BIGINT << len(items)))) AS mask FROM t),
s AS (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM m), f AS (SELECT items, count(*) AS freq FROM s GROUP BY 1 HAVING count(*) >= 40)"""
_CEN = "c AS (SELECT l_partkey AS track_id, l_orderkey AS flag, (l_suppkey % 7)::VARCHAR AS cluster FROM lineitem)"
_BAND = """c AS (SELECT floor(o_totalprice / 20)::BIGINT // 100 AS level, 'c' || (o_custkey % 12) AS cluster FROM orders),
b AS (SELECT CASE WHEN level BETWEEN 1 AND 5 THEN '1-5' WHEN level BETWEEN 5 AND 10 THEN '5-10' WHEN level BETWEEN 10 AND 15 THEN '10-15' WHEN level BETWEEN 15 AND 30 THEN '15-30' WHEN level BETWEEN 30 AND 60 THEN '30-60' WHEN level BETWEEN 60 AND 1000 THEN '60-1000' END AS band, cluster FROM c),
k AS (SELECT band, cluster, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY ALL)"""
_COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"
ORACLE_SQL = {
    "cluster_value_counts": f"WITH {_CEN} SELECT cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM c)::DOUBLE, 6) AS density FROM c GROUP BY 1 ORDER BY n DESC, cluster LIMIT 30",
    "lonely_share": "WITH l AS (SELECT o_orderpriority AS cluster FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)) SELECT cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM l)::DOUBLE, 6) AS density FROM l GROUP BY 1 ORDER BY n DESC, cluster LIMIT 30",
    "event_topic_share": f"WITH {_CEN}, n AS (SELECT count(*) FILTER (cluster IN ('0', '2')) AS events, count(*) FILTER (cluster IN ('1', '3', '4')) AS topics FROM c) SELECT events, topics, round(events / (events + topics)::DOUBLE, 6) AS event_share, round(topics / (events + topics)::DOUBLE, 6) AS topic_share FROM n",
    "focus_clusters": "WITH b AS (SELECT o_custkey AS track_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT o_custkey AS track_id, o_orderstatus AS cluster FROM orders JOIN b ON track_id = o_custkey GROUP BY o_custkey, o_orderstatus, b.n HAVING count(*) = b.n",
    "has_cluster": f"WITH {_CEN} SELECT track_id, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters FROM c GROUP BY 1 HAVING bool_or(cluster = '3')",
    "rank_bands": f"WITH {_BAND} SELECT band, sum(n)::BIGINT AS n FROM k GROUP BY 1",
    "rank_band_counts": f"""WITH {_BAND}, t AS (SELECT *, sum(n) OVER (PARTITION BY band) AS total FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY n DESC, cluster) AS r FROM t WHERE NOT (total > 20 AND n <= 1))
SELECT band, CASE WHEN r <= 8 THEN cluster ELSE 'others' END AS cluster, sum(n)::BIGINT AS n FROM r GROUP BY ALL""",
    "rank_share_pivot": f"WITH {_BAND}, s AS (SELECT band, cluster, round(n / sum(n) OVER (PARTITION BY band)::DOUBLE, 6) AS share FROM k) SELECT cluster, " + ", ".join(f"coalesce(max(share) FILTER (band = '{a}-{b}'), 0.0)::DOUBLE AS \"{a}-{b}\"" for a, b in report.BANDS) + " FROM s GROUP BY 1",
    "power_law_fit": """WITH v AS (SELECT l_returnflag AS key, sum(l_quantity)::BIGINT::DOUBLE AS x FROM lineitem GROUP BY l_partkey, l_returnflag), m AS (SELECT key, min(x) AS lo, max(x) AS hi, avg(x) AS mean FROM v GROUP BY 1),
g AS (SELECT *, ceil(round(10 * (log10(hi) - log10(lo)), 9))::INT AS n FROM m), ed AS (SELECT key, mean, n, i, round(pow(10.0, log10(lo) + (log10(hi) - log10(lo)) * i / greatest(n - 1, 1)), 6) AS e FROM g, range(100) r(i) WHERE i < greatest(n, 1)),
l AS (SELECT key, mean, list_sort(list(DISTINCT CASE WHEN i = greatest(n - 1, 0) THEN ceil(e) ELSE floor(e) END)) AS e FROM ed GROUP BY ALL),
b AS (SELECT v.key, mean, e, least(len(list_filter(e, lambda t: t <= v.x)), len(e) - 1) AS b FROM v JOIN l ON l.key = v.key), p AS (SELECT key, mean, log10((e[b] + e[b + 1]) / 2) AS x, log10(count(*)) AS y FROM b WHERE b >= 1 GROUP BY key, mean, e, b),
f AS (SELECT key, count(*) AS k, regr_slope(y, x) AS s, regr_intercept(y, x) AS c FROM p GROUP BY 1)
SELECT p.key, CASE WHEN k > 3 THEN round(s, 6) END AS slope, CASE WHEN k > 3 THEN round(sqrt(avg(pow(y - s * x - c, 2))) / avg(y), 6) END AS sigma, round(mean, 6) AS mean FROM p JOIN f ON f.key = p.key GROUP BY p.key, mean, k, s, c""",
    "transactions": f"WITH {_B} SELECT array_to_string(items, '+') AS items FROM t",
    "frequent_itemsets": f"WITH {_B} SELECT items, freq FROM f1 UNION ALL SELECT a || '+' || b, freq FROM f2",
    "itemset_report": f"WITH {_B} SELECT a || '+' || b AS items, freq FROM f2 WHERE freq > 1",
    "frequent_itemsets_all": f"WITH {_ALL} SELECT array_to_string(items, '+') AS items, freq FROM f",
    "itemset_report_all": f"WITH {_ALL} SELECT array_to_string(items, '+') AS items, freq FROM f WHERE len(items) > 1",
    "frequent_pairs": "WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY ALL HAVING count(*) >= 3",
    "association_rules": f"""WITH {_B}, r AS (SELECT f2.a AS antecedent, f2.b AS consequent, f2.freq / f1.freq::DOUBLE AS c FROM f2 JOIN f1 ON f1.items = f2.a UNION ALL SELECT f2.b, f2.a, f2.freq / f1.freq::DOUBLE FROM f2 JOIN f1 ON f1.items = f2.b
UNION ALL SELECT x.ante, x.cons, x.freq / f1.freq::DOUBLE FROM (SELECT a AS ante, b || '+' || c AS cons, freq FROM f3 UNION ALL SELECT b, a || '+' || c, freq FROM f3 UNION ALL SELECT c, a || '+' || b, freq FROM f3) x JOIN f1 ON f1.items = x.ante
UNION ALL SELECT p.a || '+' || p.b, x.cons, x.freq / p.freq::DOUBLE FROM (SELECT a AS x, b AS y, c AS cons, freq FROM f3 UNION ALL SELECT a, c, b, freq FROM f3 UNION ALL SELECT b, c, a, freq FROM f3) x JOIN f2 p ON p.a = x.x AND p.b = x.y)
SELECT antecedent, consequent, round(c, 6) AS confidence FROM r WHERE c >= 0.05""",
    "association_rules_all": f"""WITH {_ALL}, k AS (SELECT items, freq, unnest(range(1, (1::BIGINT << len(items)) - 1)) AS mask FROM f WHERE len(items) > 1),
r AS (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c, freq FROM k)
SELECT array_to_string(a, '+') AS antecedent, array_to_string(c, '+') AS consequent, round(r.freq / f.freq::DOUBLE, 6) AS confidence FROM r JOIN f ON f.items = r.a WHERE r.freq / f.freq::DOUBLE >= 0.05""",
    "classify_tags": f"""WITH m AS (SELECT e.vec_id % 50 AS doc_id, e.vec_id, h.vec_id % 6 + 1 AS rank, max(round({_COS.format('e.embedding', 'h.embedding')}, 9)) AS sim FROM embeddings e JOIN embeddings h ON h.vec_id < 30 GROUP BY ALL),
v AS (SELECT doc_id, vec_id, arg_min(rank, [-sim, rank]) AS num, max(sim) AS sim FROM m GROUP BY ALL), c AS (SELECT doc_id, num FROM v WHERE sim >= 0.25 GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(num || ':c' || num, '|' ORDER BY num), '0:others') AS clusters FROM (SELECT DISTINCT doc_id FROM v) d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY 1""",
    "dbscan": """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), n AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON list_distance(a.vec, b.vec) <= 1.15),
c AS (SELECT id FROM n GROUP BY 1 HAVING count(*) >= 5), l AS (SELECT * FROM n WHERE id IN (FROM c) AND other IN (FROM c)), r(id, reach) AS (SELECT id, id FROM c UNION SELECT r.id, l.other FROM r JOIN l ON l.id = r.reach),
m AS (SELECT id, min(reach) AS root FROM r GROUP BY 1), k AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS num FROM m), b AS (SELECT n.id, min(k.num) AS reach FROM n JOIN k ON k.id = n.other GROUP BY 1)
SELECT p.id, coalesce(k.num, b.reach, -1) AS label FROM p LEFT JOIN k ON k.id = p.id LEFT JOIN b ON b.id = p.id""",
    "cluster_report": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), a AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL), m AS (SELECT label, list(m ORDER BY pos) AS mean FROM a GROUP BY 1),
f AS (SELECT e.label, vec_id AS id, vec_id % 9 AS n, round(list_distance(embedding::DOUBLE[], mean), 9) AS dist FROM embeddings e JOIN m ON m.label = e.label), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, id) AS r FROM f)
SELECT label, count(*) AS size, round(avg(n), 6) AS mean_n, arg_min(id, r) AS medoid, string_agg(id::VARCHAR, '+' ORDER BY r) FILTER (r <= 5) AS nearest FROM r GROUP BY 1""",
    "silhouette": """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings), m AS (SELECT a.id, a.label, b.label AS other, avg(list_distance(a.vec, b.vec)) AS mean FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
g AS (SELECT id, label, max(mean) FILTER (other = label) AS a, min(mean) FILTER (other <> label) AS b FROM m GROUP BY ALL) SELECT id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS s FROM g""",
    "cluster_label_stats": "SELECT c_nationkey AS label, count(*) AS n, round(avg(c_acctbal), 4) AS c_acctbal_mean, round(stddev_samp(c_acctbal), 4) AS c_acctbal_std, round(max(c_acctbal), 4) AS c_acctbal_max, round(min(c_acctbal), 4) AS c_acctbal_min FROM customer GROUP BY 1",
}
