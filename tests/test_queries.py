"""Queries against their SQL on the smallest tables."""

import glob
import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")

from pulsespark.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = ("hourly_dense_sequence", "peak_heads", "breakout_extent", "tagged_tracks", "top_tags", "tfidf", "frequent_pairs", "association_rules", "power_law_fit", "classify_tags", "bigrams", "lexicon_consolidate",
        "cluster_sets_across_breakouts", "tagged_documents", "feature_words", "source_reviews_lines", "source_playlists", "source_text_files", "dbscan")
LARGER = ("breakout_day_text", "census", "lonely_histogram", "focus_top_shares")


def connected(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def db():
    return connected(SF)


def canonical(rows):
    show = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert canonical(df.select(*columns).collect()) == canonical(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
@pytest.mark.parametrize("name", LARGER)
def test_query_equals_sql_on_more(spark, name):
    df, want = QUERIES[name](spark, "/root/testdata/sf0.01"), connected("/root/testdata/sf0.01").sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    got = canonical(df.select(*columns).collect())
    assert columns == sorted(want.columns) and got == canonical(want.select(*(f'"{c}"' for c in columns)).fetchall()) and got


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_itemsets_of_every_size(spark, db, tmp_path):
    brands = [[1, 2, 3, 4]] * 50 + [[1, 2]] * 10  # each order with an own last part, so that transactions differ
    lines = [(o, p) for o, ps in enumerate(brands) for p in [*ps, 100 + o]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"b{p:03}") for p in [1, 2, 3, 4, *range(100, 160)]], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, most in (("association_rules", 3), ("association_rules_all", 4)):  # the SQL of the first ends with sets of three
        got = canonical(QUERIES[name](spark, str(tmp_path)).select("antecedent", "consequent", "confidence").collect())
        assert got == canonical(con.sql(ORACLE_SQL[name]).select("antecedent", "consequent", "confidence").fetchall())
        assert max(len(f"{r[0]}+{r[1]}".split("+")) for r in got) == most
    for name, sizes in (("frequent_itemsets_all", {1, 2, 3, 4}), ("itemset_report_all", {2, 3, 4})):
        got = canonical(QUERIES[name](spark, str(tmp_path)).select("items", "freq").collect())
        assert got == canonical(con.sql(ORACLE_SQL[name]).select("items", "freq").fetchall())
        assert {r[0].count("+") + 1 for r in got} == sizes


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_leaders_come_from_all_vectors(spark):
    tags = [int(t[1:]) for r in QUERIES["leader_clusters"](spark, SF).collect() for t in r.tags.split("+")]
    assert len(tags) == len(set(tags)) and max(tags) >= 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", ("top_tags", "lyric_keywords", "tag_pool", "top_bigrams"))
def test_texts_are_moved_and_never_their_words(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert {re.sub(r"#\d+L?", "", k) for k in keys} == {"doc_id"} and len(keys) <= 1 + (name == "tag_pool") and plan.count(r"\p{L}+|\p{N}+") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
@pytest.mark.parametrize("name", ("breakout_day_text", "census", "influence_tag_clusters"))
def test_documents_stay_where_they_are(spark, name):
    from pulsespark.plans import census_queries

    plan = (census_queries.census if "census" in name else QUERIES[name])(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    texts = plan.count("coalesce(text#")
    assert texts and plan.count("rightHint=(strategy=broadcast)") + plan.count("leftHint=(strategy=broadcast)") > texts
