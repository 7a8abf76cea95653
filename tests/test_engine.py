"""Relational, text, cluster and itemset operators, sources and streams on small cases."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pulsespark.functions import text as X
from pulsespark.functions import vectors as V
from pulsespark.operators import census, changepoint, cluster, embed, itemsets, relational, report, words
from pulsespark.sources import sinks, tables
from pulsespark.streaming.counts import streaming_counts


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_marks_go_in_order(spark):
    assert one(spark, "aZ~Zb~", lambda t: X.strip_marks(t, ["ZZ", "~"])) == "aZZb"
    assert one(spark, "aZ~Zb~", lambda t: X.strip_marks(t, ["~", "ZZ"])) == "ab"


def test_spaces_between_latin_letters(spark):
    twice = lambda t: F.regexp_replace(F.regexp_replace(t, "([a-z]+) ([a-z]+)", "$1空$2"), "([a-z]+) ([a-z]+)", "$1空$2")
    rng = random.Random(9)
    for text in ("a b c d e", "aB c  d Ef g", *("".join(rng.choice("ab B ") for _ in range(60)) for _ in range(20))):
        assert one(spark, text, X.glue_latin) == one(spark, text, twice)


def test_emoticons(spark):
    assert one(spark, "x (^_^)> y (^^^^^) 1(^o^)", lambda t: X.emoticons(t, "(^_)>*")) == ["(^_^)>"]


def test_token_filter(spark):
    kept = one(spark, "", lambda t: X.filter_tokens(F.array(*(F.lit(x) for x in ("A", "aa", "ab", "12", "a.b", "第x", "the", "Word", "x!"))), ["the"], "!"))
    assert kept == ["ab", "word"]


def test_bigrams_and_sentences(spark):
    assert one(spark, "", lambda t: X.bigrams(F.array(F.lit("中"), F.lit("文"), F.lit("a"), F.lit("b")))) == ["中文", "文a"]
    assert one(spark, "", lambda t: X.bigrams(F.array(F.lit("中")))) == []
    assert len(one(spark, "a b c。d e？f g h i", lambda t: X.sentences(t))) == 2


def test_lyrics(spark):
    got = one(spark, "[00:12.50][01:02.00] first \n[00:01.10]second\nnone", X.lyric_lines)
    assert [(r.mark, r.text) for r in got] == [("[00:01.10]", "second"), ("[00:12.50]", "first"), ("[01:02.00]", "first")]
    assert [r.mark for r in one(spark, "a\nb", X.lyric_lines)] == [None, None]


def test_tagged_tracks_meet_as_lists(spark):
    rows = [("p", 1, ["a", "b", "a"], ["x", "y", "x"]), ("p", 1, ["c", "a"], ["y", "z"]), ("p", 2, ["a"], ["x"]), ("q", 1, [], ["x"]), ("q", None, ["a", None], ["x", None]), ("r", 1, None, ["x"])]
    got = relational.tagged_tracks(spark.createDataFrame(rows, "id string, user_id long, tags array<string>, tracks array<string>"))
    assert len(got.collect()) == got.distinct().count()
    assert {tuple(r) for r in got.select("track_id", "tag", "user_id", "playlist_id").collect()} == {(t, g, u, p) for p, u, gs, ts in rows for g in gs or () for t in ts}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("track_id" in x for x in plan.split("\n") if "Exchange" in x)


def test_partners_are_dealt_by_the_rows(spark, monkeypatch):
    rows = [(i % 40, (i * i) % 23) for i in range(600)] * 2 + [(None, 1), (3, None)]
    bridge, tracks = spark.createDataFrame(rows, "playlist_id long, track_id long"), spark.createDataFrame([(t,) for t in range(0, 23, 2)], "track_id long")
    monkeypatch.setattr(relational, "PART", 100)
    got = relational.co_playlist_partners(bridge, tracks)
    held = {}
    for p, t in {r for r in rows if r[0] is not None and r[1] is not None}:
        held.setdefault(p, set()).add(t)
    want = {}
    for ts in held.values():
        for a, b in itertools.product(ts, ts):
            if a % 2 == 0:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.track_id, r.partner): r.n for r in got.where("partner is not null").collect()} == want
    assert ", 13), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_top_words_ties_by_first_sight(spark):
    docs = spark.createDataFrame([(1, "b a b a c"), (2, "")], "doc_id long, text string")
    got = words.top_words(docs, X.tokens(F.col("text")), 2).orderBy("rank").collect()
    assert [(r.word, r.n) for r in got] == [("b", 2), ("a", 2)]


def test_coherence_without_pairs(spark):
    rng = random.Random(3)
    rows = [(i % 3, i // 2, [rng.gauss(0.3, 1) for _ in range(5 - (i % 7 == 0))]) for i in range(60)] + [(0, 90, None), (1, 91, [0.0] * 5), (2, 92, [1.0, None, 0.0, 0.0, 0.0]), (3, 1, None)]
    m = spark.createDataFrame(rows, "doc long, pos long, vec array<double>")
    pairs = m.join(m.select("doc", F.col("pos").alias("q"), F.col("vec").alias("w")), "doc").where("pos <= q").groupBy("doc").agg(F.avg(V.cosine("vec", "w")).alias("mean_cos"), F.count("*").alias("pairs"))
    show = lambda df: {r.doc: (r.mean_cos and round(r.mean_cos, 9), r.pairs) for r in df.collect()}
    assert show(words.coherence(m)) == show(pairs)
    many = spark.range(30_000).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))  # 450 million pairs
    assert show(words.coherence(many)) == {1: (1.0, 30_000 * 30_001 // 2)}


def test_rerank(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "word string, vec array<double>")
    cands = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.9), (1, "c", 0.3), (1, "oov", 5.0)], "doc_id long, word string, weight double")
    assert [r.word for r in words.diversity_rerank(cands, vectors, 3).orderBy("rank").collect()] == ["a", "c", "b"]


def test_itemsets_against_enumeration(spark):
    sets = [{"a", "b", "c"}, {"a", "b"}, {"a", "c"}, {"b", "c", "d"}, {"a", "b", "c", "d"}, {"a", "b"}]
    df = spark.createDataFrame([(sorted(s) * 2,) for s in sets], "items array<string>")
    distinct = {frozenset(s) for s in sets}
    support = {c: sum(set(c) <= s for s in distinct) for n in (1, 2, 3, 4) for c in itertools.combinations("abcd", n)}
    for least in (1, 2, 3):
        found = itemsets.frequent(itemsets.transactions(df), least)
        assert {tuple(r["items"]): r.freq for r in found.collect()} == {c: n for c, n in support.items() if n >= least}
    got = {(tuple(r.antecedent), tuple(sorted(r.consequent))): r.confidence for r in itemsets.rules(found, 0.6).collect()}
    want = {}
    for c, n in support.items():
        if n >= 3:
            for k in range(1, len(c)):
                for a in itertools.combinations(c, k):
                    if n / support[a] >= 0.6:
                        want[a, tuple(x for x in c if x not in a)] = n / support[a]
    assert got == pytest.approx(want)


def test_leader_clusters_keep_their_invariants(spark):
    vecs = {"a": [1.0, 0.05], "b": [0.99, 0.1], "c": [0.05, 1.0], "d": [0.1, 0.99]}
    pool = [(i, t, vecs[t]) for i, t in enumerate("aabcddcab" * 3)]
    got = cluster.leader_clusters(spark.createDataFrame(pool, "seq long, tag string, vec array<double>"), 0.7, 3).orderBy("rank").collect()
    tags = [t for r in got for t in r.tags]
    assert len(tags) == len(set(tags)) and [r["count"] for r in got] == sorted((r["count"] for r in got), reverse=True)
    assert {frozenset(r.tags) for r in got} == {frozenset("ab"), frozenset("cd")}
    assert sum(r["count"] for r in got) == 28  # the first tag counts twice
    assert cluster.leader_clusters(spark.createDataFrame([], "seq long, tag string, vec array<double>")).count() == 0


def plain_leaders(pool, affinity, least, every):
    """Clusters [count, {tag: n}] before they merge, every closeness by itself."""
    unit = {t: [x / math.hypot(*v) for x in v] for _, t, v in pool}
    center = lambda c: max(c, key=c.get)
    clusters, taken = [{pool[0][1]: 1}], 0
    for _, tag, _ in pool:
        near = [1.0 if tag in c else sum(x * y for x, y in zip(unit[center(c)], unit[tag])) for c in clusters]
        top = near.index(max(near)) if near else -1
        if near and near[top] > affinity:
            clusters[top][tag] = clusters[top].get(tag, 0) + 1
        else:
            clusters.append({tag: 1})
        taken += 1
        if taken % every == 0:
            clusters, least = [c for c in clusters if sum(c.values()) > least], least + 1
    return [c for c in clusters if sum(c.values()) > least]


def test_leader_clusters_keep_their_centers(spark, monkeypatch):
    rng = random.Random(8)
    names = {f"t{i}": [rng.gauss(0, 1) for _ in range(6)] for i in range(300)}
    pool = [(i, t, names[t]) for i, t in enumerate(rng.choice(list(names)) for _ in range(1500))]
    monkeypatch.setattr(cluster, "_merge", lambda clusters, *_: clusters)
    df = spark.createDataFrame(pool, "seq long, tag string, vec array<double>").coalesce(1)
    grown = {}
    monkeypatch.setattr(type(df), "groupBy", lambda self, *_: type("G", (), {"applyInPandas": lambda _, f, schema: grown.update(out=f(self.toPandas()))})())
    cluster.leader_clusters(df, 0.6, 1, 200)
    monkeypatch.undo()
    want = plain_leaders(pool, 0.6, 1, 200)
    assert len(want) > 5 and sorted((c, k, sorted(t)) for c, k, t in zip(grown["out"]["count"], grown["out"]["center"], grown["out"]["tags"])) == sorted((sum(c.values()), max(c, key=c.get), sorted(c)) for c in want)


def test_clusters_merge_piece_by_piece(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = {f"t{i}": v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(200, 4)) + 2 * rng.normal(size=(8, 4))[np.arange(200) % 8])}

    def merged():
        clusters = []
        for k in range(20):
            clusters.append(cluster._Cluster())
            for t in list(vectors)[k::20]:
                clusters[-1].add(t)
        return [(c.count, c.center(), list(c.tags)) for c in cluster._merge(clusters, vectors, 0.6)]

    want = merged()
    monkeypatch.setattr(cluster, "PRODUCTS", 7)
    assert merged() == want and 1 < len(want) < 20


def test_dbscan(spark):
    pts = [(i, [float(i % 3) * 0.1, 0.0]) for i in range(6)] + [(10 + i, [5.0 + 0.1 * i, 5.0]) for i in range(4)] + [(99, [50.0, 50.0])]
    got = {r.id: r.label for r in cluster.dbscan(spark.createDataFrame(pts, "id long, vec array<double>"), 0.5, 3).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{10 + i: 1 for i in range(4)}, 99: -1}


def plain_dbscan(points, eps, least):
    near = {i: [j for j, w in points if math.dist(v, w) <= eps] for i, v in points}
    core, label, num = {i for i in near if len(near[i]) >= least}, {}, 0
    for i in sorted(core):
        if i not in label:
            queue = [i]
            while queue:
                x = queue.pop()
                if x not in label:
                    label[x] = num
                    queue += [j for j in near[x] if j in core]
            num += 1
    reached = {i: min((label[j] for j in near[i] if j in core), default=-1) for i in near}
    return {i: label.get(i, reached[i]) for i in near}


@pytest.mark.parametrize("block", [7, 1024])
def test_dbscan_of_whole_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = random.Random(6)
    centers = [[rng.uniform(-3, 3) for _ in range(12)] for _ in range(5)]
    points = [(3 * i + 1, [c + rng.gauss(0, 0.5) for c in rng.choice(centers)]) for i in range(90)] + [(1000, [9.0] * 12)]
    got = {r.id: r.label for r in cluster.dbscan(spark.createDataFrame(points, "id long, vec array<double>"), 2.0, 4).collect()}
    want = plain_dbscan(points, 2.0, 4)
    assert got == want and len(set(want.values())) > 3


def test_points_are_sent_as_often_as_there_are_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 4)
    for n, blocks in ((3, 1), (40, 10), (400, 16)):
        points = spark.range(n).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("vec"), (F.col("id") % 3).alias("label"))
        assert cluster._blocks(points) == blocks and cluster._paired(points, blocks).count() == n * blocks
    want = plain_dbscan([(i, [float(i), 0.0]) for i in range(400)], 1.5, 3)
    assert {r.id: r.label for r in cluster.dbscan(points, 1.5, 3).collect()} == want and cluster.silhouette(points).count() == 400


@pytest.mark.parametrize("block", [5, 1024])
def test_silhouette(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = random.Random(2)
    points = [(i, [rng.gauss(3 * (i % 3), 1) for _ in range(4)], i % 3) for i in range(40)] + [(50, [9.0] * 4, 7)]
    got = {r.id: r.s for r in cluster.silhouette(spark.createDataFrame(points, "id long, vec array<double>, label long")).collect()}
    for i, v, label in points:
        mean = {}
        for other in {p[2] for p in points}:
            far = [math.dist(v, w) for j, w, k in points if k == other and j != i]
            mean[other] = sum(far) / len(far) if far else None
        a, b = mean.pop(label), min(mean.values())
        assert got[i] == pytest.approx((b - a) / max(a, b) if a is not None else 0.0)
    assert cluster.run_name("pool", 0.65, "b1") == "pool_065b1"


def test_classify_with_more_clusters_than_are_sent(spark):
    tags = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "doc_id long, tag string, vec array<double>")
    heads = spark.createDataFrame([(i, f"c{i}", [[0.1, float(i)]]) for i in range(1, 8)] + [(8, "c8", [[1.0, 0.1]])], "rank long, center string, vecs array<array<double>>")
    got = {r.doc_id: [tuple(c) for c in r.clusters] for r in cluster.classify(tags, heads, few=3).collect()}
    assert got == {1: [(8, "c8")], 2: [(7, "c7")]}


def test_rules_of_large_sets(spark):
    big = spark.createDataFrame([([f"i{k}" for k in range(31)], 3)], "items array<string>, freq long")
    with pytest.raises(Exception, match="more than 30 items"):
        itemsets.rules(big).collect()


def test_words_are_trained_by_several_tasks(spark, monkeypatch):
    import pyspark.ml.feature as ml

    monkeypatch.setattr(embed, "PART", 1000)
    parts, fit = [], ml.Word2Vec.fit
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda self, *a: parts.append(self.getNumPartitions()) or fit(self, *a))
    rows = lambda n: spark.createDataFrame([(i, ["a", "b", "c"] * 5) for i in range(n)], "doc_id long, words array<string>")
    for n in (10, 150, 2000):
        model = embed.train_words(rows(n), size=4, least=2, rounds=1)
        assert sorted(r.word for r in model.getVectors().collect()) == ["a", "b", "c"]
    assert parts == [1, 2, spark.sparkContext.defaultParallelism]


def test_dictionary_without_bound(spark):
    counts = spark.createDataFrame([(d, w, 1) for d in range(3) for w in "abcde"], "doc_id long, word string, tf long")
    assert words.dictionary(counts, 3, 1, 1.0, 2).count() == 2 and words.dictionary(counts, 3, 1, 1.0, None).count() == 5


def test_consolidate(spark):
    grams = spark.createDataFrame([("a.b",), ("axb",), ("c+",), ("a.b",), ("d",)], "word string")
    assert sorted(r.word for r in words.consolidate(grams, ("a.b", "+")).collect()) == ["axb", "d"]
    assert words.consolidate(grams, ()).count() == 4 and words.consolidate(grams, ("q", "")).count() == 0


def test_kernel_segmentation_of_a_long_series(spark):
    y = [3.0 + (i * 7 % 5) for i in range(2500)] + [40.0 + (i * 7 % 5) for i in range(2600)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(y)], "key string, idx long, y double")
    assert [r.at for r in changepoint.pelt(df).collect()] == [2500]


def test_census_sets_and_matches(spark):
    rows = [("a", [(1, "x"), (2, "y")]), ("a", [(3, "z")]), ("b", [(1, "x")]), ("c", [(0, "others")]), ("c", [(2, "y")]), ("d", [(2, "y"), (1, "x")]), ("d", [(2, "y")])]
    df = spark.createDataFrame(rows, "key string, clusters array<struct<num:long,center:string>>")
    assert [r["items"] for r in census.sets_across_bursts(df).collect()] == [[1, 3]]
    assert sorted(r["items"] for r in census.sets_within_bursts(df).collect()) == [[1, 2], [1, 2]]
    tracks = spark.createDataFrame([(1,), (2,)], "track_id long")
    files = spark.createDataFrame([(1, "a/1"), (1, "b/1"), (3, "c/3")], "track_id long, path string")
    assert [tuple(r) for r in census.with_lyrics(tracks, files).collect()] == [(1, "b/1")]
    values = spark.createDataFrame([(float(v),) for v in (0, 1, 9, 10)], "v double")
    assert sorted((r.bin, r.n, r.mean) for r in census.histogram(values, "v", 5).collect()) == [(0, 2, 5.0), (4, 2, 5.0)]
    fits = spark.createDataFrame([("a", 20, -1.0, 0.5), ("b", 20, -1.0, 0.9), ("c", 20, None, None), ("d", 3, -1.0, 0.1)], "label string, n long, slope double, sigma double")
    assert [(r.label, r.keep_rate) for r in census.kept_fits(fits).collect()] == [("a", 50.0)]


def test_features_of_short_and_long_documents(spark):
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.1), (2, "d", 1.0)], "doc_id long, word string, weight double")
    said = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"]), (3, [])], "doc_id long, words array<string>")
    got = sorted((r.doc_id, r["rank"], r.word) for r in census.feature_words(weights, said, 2).collect())
    assert got == [(1, 1, "b"), (1, 2, "a"), (2, 1, "z")]


def test_models_and_runs_are_kept(spark, tmp_path):
    from pyspark.ml.clustering import KMeans, KMeansModel
    from pyspark.ml.linalg import Vectors

    model = KMeans(k=2, seed=1).fit(spark.createDataFrame([(Vectors.dense(float(i > 2) * 9),) for i in range(6)], ["features"]))
    for _ in range(2):
        sinks.save_model(model, str(tmp_path / "m"))
    assert len(KMeansModel.load(str(tmp_path / "m")).clusterCenters()) == 2
    sinks.log_run(spark, str(tmp_path / "runs"), "one", affinity=0.7)
    assert [(r.name, r.parameters) for r in sinks.log_run(spark, str(tmp_path / "runs"), "two", k=6).orderBy("name").collect()] == [("one", '{"affinity": 0.7}'), ("two", '{"k": 6}')]


def test_classify_without_vote(spark):
    tags = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [-1.0, 0.0])], "doc_id long, tag string, vec array<double>")
    heads = spark.createDataFrame([(1, "c", [[1.0, 0.0]])], "rank long, center string, vecs array<array<double>>")
    got = {r.doc_id: [tuple(c) for c in r.clusters] for r in cluster.classify(tags, heads).collect()}
    assert got == {1: [(1, "c")], 2: [(0, "others")]}


def test_bands_and_sampling(spark):
    df = spark.createDataFrame([(50,), (100,), (599,), (600,), (10**6,)], "n long")
    assert sorted((r.n, r.band) for r in report.bands(df).collect()) == [(100, "1-5"), (599, "1-5"), (600, "5-10")]
    rows = spark.createDataFrame([("g", i) for i in range(777)], "g string, i long")
    want = sorted({round(i * 776 / 499) for i in range(500)})
    assert sorted(r.i for r in relational.spaced_sample(rows, "g", "i", 500).collect()) == want


def test_power_law_tries_every_minimum(spark):
    rng = random.Random(4)
    values = [v for v in range(1, 120) for _ in range(30)] + [math.floor(119.5 * (1 - rng.random()) ** (-1 / 1.5) + 0.5) for _ in range(8000)]
    got = report.power_law_mle(spark.createDataFrame([("k", v) for v in values], "key string, x long")).first()
    assert got.xmin >= 110 and got.alpha == pytest.approx(2.5, abs=0.15) and got.n_tail == sum(v >= got.xmin for v in values)
    steep = [v for v in range(200, 260) for _ in range(round(1e5 * (v / 200) ** -30.0))]
    got = report.power_law_mle(spark.createDataFrame([("k", v) for v in steep], "key string, x long")).first()
    assert got.alpha == pytest.approx(30, abs=1)


def test_dynamic_keeps_long_quiet_segments(spark):
    y = [0.0 if i < 500 else 20.0 * min((i - 500) // 20 + 1, 10) for i in range(720)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(y)], "key string, idx long, y double")
    assert [r.at for r in changepoint.dynamic(df).collect()] == list(range(500, 700, 20))


def test_sources(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/12.json").write_text(json.dumps([{"time": 1, "likedCount": 2, "content": "x"}]))
    assert [(r.track_id, r.content) for r in tables.reviews_json(spark, str(tmp_path / "r")).collect()] == [("12", "x")]
    (tmp_path / "l").mkdir()
    (tmp_path / "l/7.txt").write_text('{"time": 1, "likedCount": 2, "content": "x"}\nnonsense\n{"time": 1}\n')
    assert tables.reviews_lines(spark, str(tmp_path / "l")).count() == 1
    assert tables.text_files(spark, str(tmp_path / "l"), 6).first().text == '{"time'
    (tmp_path / "k.txt").write_text("1 2\n3\n")
    assert sorted((r.num, r.kind) for r in tables.kinds_of_clusters(spark, str(tmp_path / "k.txt")).collect()) == [("1", "topic"), ("2", "topic"), ("3", "event")]
    report_ = spark.createDataFrame([(1, "head\nmu  1.5 0.1 9 0.02\nar1 2.5 0.2 9 0.5\nlast line\nRobust rest")], "id long, text string")
    assert [(r.name, r.estimate, r.p) for r in tables.garch_report(report_).collect()] == [("mu", 1.5, 0.02), ("ar1", 2.5, 0.5)]


def test_sinks(spark, tmp_path):
    held, new = spark.createDataFrame([(1, "h")], "k long, v string"), spark.createDataFrame([(1, "n"), (2, "n"), (2, "n")], "k long, v string")
    assert sorted(map(tuple, sinks.insert_ignore(new, held, ["k"]).collect())) == [(1, "h"), (2, "n")]
    lines = sinks.cluster_listing(spark.createDataFrame([(1, 5, ["a", "b"])], "rank long, count long, tags array<string>")).first().value
    assert lines == "1 count:5 - [a, b]"
    census = spark.createDataFrame([("t", ["a"])], "track_id string, tags array<string>")
    sinks.write_census(census, str(tmp_path / "p"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("a", "2020-01-01 05:00:00"), ("a", "2020-01-01 06:00:00"), ("b", "2020-01-02 00:00:00")], "k string, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t string").parquet(str(tmp_path / "in"))
    q = streaming_counts(stream, "k", "t").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.key, r.y) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
