"""Null rules, ties, missing matches and duplicate keys, one small table each."""

import pytest
from pyspark.sql import functions as F

from themeloom import functions as fn
from themeloom.operators import cleaning, crosstab, distributions, joins, network, registry, reshape, text, themes


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_if_else_keeps_null(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    out = df.select("x", fn.if_else(F.col("x") >= 2, 1, 0).alias("f"))
    assert rows(out, "x") == [(None, None), (1, 0), (3, 1)]


def test_in_set_is_never_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert rows(df.select(fn.in_set("x", ["a"]))) == [(True,), (False,)]


def test_registry_join_matches_missing_ids(spark):
    apps = spark.createDataFrame([(1, None, "2014"), (2, "9", "2014")], "id int, org_nr string, aar string")
    reg = spark.createDataFrame(
        [(None, "2014", "10.1"), (None, "2014", "20.1"), ("9", "2014", "30.1")],
        "org_nr string, aar string, nace1_sn07 string",
    )
    assert registry.join_registry(apps, reg, null_keys="match").count() == 3
    never = registry.join_registry(apps, reg)
    assert rows(never.select("id", "nace"), "id") == [(1, None), (2, "30")]


def test_registry_join_is_the_same_when_keys_are_hot(spark):
    apps = spark.range(600).select(
        "id",
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "7").otherwise(F.col("id").cast("string")).alias("org_nr"),
        F.lit("2014").alias("aar"),
    )
    reg = spark.createDataFrame(
        [(None, "2014", "10.1"), ("7", "2014", "20.1"), ("7", "2014", "21.1"), ("5", "2014", "30.1")],
        "org_nr string, aar string, nace1_sn07 string",
    )
    plain = rows(registry.join_registry(apps, reg, null_keys="match"), "id", "nace")
    split = rows(registry.join_registry(apps, reg, null_keys="match", hot_rows=20), "id", "nace")
    assert joins.hot_keys(apps, ["org_nr", "aar"], 20).count() == 2
    assert len(plain) == 800 and plain == split


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    left = spark.range(500).select("id", (F.col("id") % 3 * F.lit(1)).alias("k"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "k long, v string")
    assert rows(joins.salted_join(left, right, ["k"], how, hot_rows=50), "id") is not None
    order = ["id", "k"] + (["v"] if how in ("left", "inner") else [])
    assert rows(joins.salted_join(left, right, ["k"], how, hot_rows=50).select(order), *order) == rows(
        left.join(right, "k", how).select(order), *order
    )


def test_hot_keys_have_no_limit_and_equal_rows_are_split(spark):
    many = spark.range(5_000).select((F.col("id") % 2_500).alias("k"))
    assert joins.hot_keys(many, ["k"], 2).count() == 2_500
    equal = spark.range(1_000).select(F.lit(1).alias("k")).repartition(4)
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    joined = joins.salted_join(equal, right, ["k"], "inner", hot_rows=100)
    assert joined.count() == 1_000
    salts = equal.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(10))).groupBy("salt").count()
    assert salts.count() == 10 and salts.agg(F.max("count")).first()[0] <= 130


def test_small_loadings_compare_right(spark):
    df = spark.createDataFrame([(1, "V1", 2e-7), (2, "V1", 1e-9), (3, "V1", 4e-7)], "id int, tema string, ladning double")
    assert [r.id for r in themes.high_loading(df).orderBy("id").collect()] == [3]
    wide = spark.createDataFrame([(1, 2e-7, 2e-9), (2, 1e-9, 2e-9), (3, 4e-7, 4e-9)], "id int, a double, b double")
    assert rows(cleaning.dichotomise_wide(wide, ["a"]).select("id", "a"), "id") == [(1, 0), (2, 0), (3, 1)]
    merged = themes.merge_columns(wide, {"m": ["a", "b"]}).orderBy("id").collect()
    assert [float(r.m) for r in merged] == [1.01e-7, 1.5e-9, 2.02e-7]


def test_word_counts_in_place(spark):
    df = spark.createDataFrame([(1, "b a b  A"), (2, ""), (3, None), (4, "7 x")], "id int, text string")
    out = text.counted_words(df, "id", "text", total="total")
    assert rows(out, "id", "word") == [(1, "a", 2, 4), (1, "b", 2, 4), (4, "7", 1, 2), (4, "x", 1, 2)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    stops = spark.createDataFrame([("b",), ("b",)], "word string")
    assert rows(text.counted_words(df, "id", "text", stopwords=stops, drop_numbers=True), "id", "word") == [(1, "a", 2), (4, "x", 1)]


def test_attach_beyond_the_bound(spark):
    left = spark.range(100).withColumn("k", F.col("id") % 4)
    right = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = joins.attach(left, right, ["k"], bounded=True)
    large = joins.attach(left, right, ["k"])
    assert rows(small.select("id", "v"), "id") == rows(large.select("id", "v"), "id")
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()


def test_mean_ties_stay_above(spark):
    df = spark.createDataFrame([(i, "V1", 0.1) for i in range(3)], "id int, tema string, ladning double")
    assert themes.high_loading(df).count() == 3


def test_na_rm(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", 2.0)], "id int, tema string, ladning double")
    assert {r.id for r in themes.high_loading(df).collect()} == {1, 3}
    assert {r.id for r in themes.high_loading(df, na_rm=False).collect()} == {3}
    flags = themes.dichotomise_mean(df)
    assert rows(flags.select("id", "flag"), "id") == [(1, 1), (2, None), (3, 1)]


def test_wide_flags_equal_long_flags(spark):
    data = [(i, t, float((i * 7 + j * 3) % 11)) for i in range(20) for j, t in enumerate("abc")]
    long = spark.createDataFrame(data, "id int, tema string, ladning double")
    wide = cleaning.dichotomise_wide(reshape.to_wide(long, ["id"], "tema", list("abc"), "ladning"), list("abc"))
    back = reshape.to_long(wide, ["id"], list("abc"), "tema", "flag")
    order = ["id", "tema", "flag"]
    assert rows(back.select(order), *order) == rows(themes.dichotomise_mean(long).select(order), *order)


def test_duplicate_pivot_key_stops(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "id int, tema string, ladning double")
    with pytest.raises(Exception, match="more than one row"):
        reshape.to_wide(df, ["id"], "tema", ["a"], "ladning").collect()


def test_unpivot_keeps_nulls_and_inverts_pivot(spark):
    long = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", None), (2, "a", 3.0), (2, "b", 4.0)], "id int, tema string, ladning double"
    )
    wide = reshape.to_wide(long, ["id"], "tema", ["a", "b"], "ladning")
    assert rows(reshape.to_long(wide, ["id"], ["a", "b"], "tema", "ladning"), "id", "tema") == rows(long, "id", "tema")


def test_no_match_is_null_and_concat_fills(spark):
    df = spark.createDataFrame([("x", None), ("2014/1", "b")], "a string, b string")
    assert rows(df.select(fn.first_match("a", "[0-9]{1,4}"))) == [(None,), ("2014",)]
    assert rows(cleaning.build_text(df, ["a", "b"]).select("text")) == [("x ",), ("2014/1b",)]


def test_unparsable_and_zero_division(spark):
    df = spark.createDataFrame([("x", 0), ("2", 4)], "a string, n int")
    assert rows(df.select(fn.to_number("a"), fn.percent(F.lit(1), "n"))) == [(None, None), (2.0, 25.0)]


def test_quantiles_both_ways(spark):
    data = [("a", float(v)) for v in (1, 1, 2, 5, 9, 9, 12)] + [("b", 3.0)] + [(None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = {"q1": 0.25, "m": 0.5, "q3": 0.75}
    packed = rows(distributions.quantiles_by(df, ["g"], "x", probs), "g")
    ranked = rows(distributions.quantiles_by(df, ["g"], "x", probs, max_distinct=1), "g")
    assert packed == ranked == [(None, 5.0, 6.0, 7.0), ("a", 1.5, 5.0, 9.0), ("b", 3.0, 3.0, 3.0)]
    assert rows(distributions.quantiles_by(df, [], "x", {"m": 0.5}, max_distinct=1)) == [(4.5,)]


def test_recode_defaults(spark):
    df = spark.createDataFrame([("01",), ("77",), ("00",), (None,)], "c string")
    kept = cleaning.recode(df, "c", {"01": "x"}, "o", null_codes=["00"])
    assert {tuple(r) for r in kept.collect()} == {("01", "x"), ("77", "77"), ("00", None), (None, None)}
    dropped = cleaning.recode(df, "c", df.sparkSession.createDataFrame([("01", "x")], "c string, l string"), "o", "null")
    assert {tuple(r) for r in dropped.collect()} == {("01", "x"), ("77", None), ("00", None), (None, None)}


def test_merge_needs_all_members(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.2), (1, "b", 0.4), (2, "a", 0.2), (2, "c", 0.9)], "id int, tema string, ladning double"
    )
    strict = themes.merge_themes(df, {"a": ["a", "b"]})
    loose = themes.merge_themes(df, {"a": ["a", "b"]}, require_all=False)
    value = F.col("ladning").cast("double")
    assert rows(strict.select("id", "tema", value), "id", "tema") == [(1, "a", 0.3), (2, "a", None), (2, "c", 0.9)]
    assert rows(loose.select("id", "tema", value), "id", "tema") == [(1, "a", 0.3), (2, "a", 0.2), (2, "c", 0.9)]


def test_any_flag(spark):
    df = spark.createDataFrame([(1, None), (0, None), (0, 0)], "a int, b int")
    assert rows(df.select(fn.any_flag(["a", "b"]))) == [(1,), (None,), (0,)]


def test_natural_anti_join_uses_firm_and_count(spark):
    # Firm x: three rows, two on one theme. Firm y: two rows, both on one theme.
    df = spark.createDataFrame(
        [("x", "a"), ("x", "a"), ("x", "b"), ("y", "a"), ("y", "a"), ("z", "a"), ("z", "b"), (None, "a"), (None, "b")],
        "org_nr string, tema string",
    )
    pairs = themes.count_by(df, ["org_nr", "tema"]).where("n > 1")
    firms = themes.count_by(df, ["org_nr"]).where("n > 1")
    kept = {r.org_nr for r in joins.anti_join_natural(firms, pairs).collect()}
    assert kept == {"x", "z", None}
    edges = network.multi_theme_firms(df, "org_nr", "tema")
    assert rows(edges, "org_nr", "tema") == [("x", "a", 3), ("x", "b", 3), ("z", "a", 2), ("z", "b", 2)]
    assert rows(network.theme_firm_count(df, "org_nr", "tema"), "tema") == [("a", 3), ("b", 2)]


def test_network_degree_is_twice_the_weight(spark):
    edges = spark.createDataFrame(
        [("f1", "a"), ("f1", "b"), ("f1", "c"), ("f2", "a"), ("f2", "b"), ("f3", "c"), ("f4", "b"), ("f4", "a")],
        "org_nr string, tema string",
    )
    pairs = network.project_bipartite(edges, "org_nr", "tema")
    assert rows(pairs, "src", "dst") == [("a", "b", 3), ("a", "c", 1), ("b", "c", 1)]
    degree = network.weighted_degree(pairs)
    assert degree.agg(F.sum("grad")).first()[0] == 2 * pairs.agg(F.sum("weight")).first()[0]
    assert network.bipartite_check(edges, "org_nr", "tema").first().tomodus
    loops = spark.createDataFrame([("a", "a", 5), ("a", "b", 1), ("b", "a", 2)], "src string, dst string, weight long")
    assert rows(network.simplify_edges(loops)) == [("a", "b", 3)]


def test_crosstab_units_and_complete_cases(spark):
    df = spark.createDataFrame(
        [(1, "N", "a", 1), (1, "N", "b", 1), (2, "N", "a", 0), (2, "N", "b", 0), (3, None, "a", 1), (3, None, "b", 0)],
        "id int, dim string, tema string, flag int",
    )
    mentions = crosstab.crosstab_share(df, ["dim"])
    assert rows(mentions, "dim") == [(None, 1, 1, 50.0), ("N", 2, 2, 50.0)]
    documents = crosstab.crosstab_share(df, ["dim"], unit="documents")
    assert rows(documents, "dim") == [(None, 0, 1, 100.0), ("N", 1, 1, 50.0)]
    assert rows(crosstab.crosstab_count(df, ["dim", "tema"]), "tema") == [("N", "a", 1), ("N", "b", 1)]
    total = crosstab.crosstab_share(df, [])
    assert total.first().med == mentions.agg(F.sum("med")).first()[0]


def test_repeated_texts_do_not_change_tf_idf(spark):
    docs = spark.createDataFrame([(1, "Sol og vind, sol!"), (2, "vind 42"), (3, "hav")], "id int, text string")
    once = text.tf_idf(text.doc_term_counts(text.tokenize(docs, "id", "text"), drop_numbers=False))
    thrice = docs.unionByName(docs).unionByName(docs)
    again = text.tf_idf(text.doc_term_counts(text.tokenize(thrice, "id", "text"), drop_numbers=False))
    cols = ["id", "word", "tf", "idf", "tf_idf"]
    assert rows(once.select(cols), "id", "word") == rows(again.select(cols), "id", "word")
    assert all(abs(r[1] - 1) < 1e-12 for r in once.groupBy("id").agg(F.sum("tf")).collect())


def test_tokens_numbers_urls(spark):
    docs = spark.createDataFrame([(1, "Se https://x.no/a?b=1 nå, 42 ÆØÅ")], "id int, text string")
    words = text.tokenize(docs, "id", "text", drop_urls=True)
    assert {r.word for r in words.collect()} == {"se", "nå", "42", "æøå"}
    assert {r.word for r in text.doc_term_counts(words, stopwords=["se"]).collect()} == {"nå", "æøå"}


def test_levels(spark):
    df = spark.createDataFrame([("b", 5.0), ("b", 7.0), ("a", 9.0), ("c", 1.0)], "l string, x double")
    assert rows(cleaning.reorder_levels(df, "l", "x").select("l", "ord"), "ord") == [("c", 1), ("b", 2), ("a", 3)]
    placed = cleaning.level_order(df.select("l"), "l", ["c", "a"])
    assert {tuple(r) for r in placed.select("l", "l_ord").collect()} == {("c", 1), ("a", 2), (None, None)}


def test_same_result_however_partitioned(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).cast("string").alias("tema"), (F.rand(3) * 10).alias("ladning"))
    df = df.persist()
    a = themes.high_loading(df.repartition(1)).count()
    assert a == themes.high_loading(df.repartition(37)).count() > 0
    one = distributions.summary_by(df.repartition(1), ["tema"], "ladning")
    many = distributions.summary_by(df.repartition(37), ["tema"], "ladning")
    assert rows(one, "tema") == rows(many, "tema")


def test_density_sums_to_one(spark):
    df = spark.range(2000).select(F.lit("a").alias("g"), F.randn(5).alias("x"))
    grid = distributions.kde(df, "g", "x").toPandas().sort_values("punkt")
    step = grid.x.iloc[1] - grid.x.iloc[0]
    assert abs(grid.tetthet.sum() * step - 1) < 0.02


def test_boxplot(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, x double")
    assert rows(distributions.boxplot_stats(df, ["g"], "x")) == [("a", 2.0, 3.0, 4.0, 1.0, 4.0, 1)]


def test_tfidf_vectors_of_odd_texts(spark, tmp_path):
    """Texts without words or without text go, and one with the whole vocabulary stays."""
    import duckdb

    import __spark_entry__ as entry_module

    rows = [(i, f"w{i % 4} w{i % 4} w{i % 3} rare{i}") for i in range(300)] + [(300, ""), (301, "... !"), (302, None), (303, "w0 w1 w2 w3")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(f"SELECT id, ulike, tf_idf FROM ({entry_module.oracle_sql()['tfidf_vectors']})").fetchall()}
    found = {r.id: (r.ulike, r.tf_idf) for r in entry_module.queries()["tfidf_vectors"](spark, str(tmp_path)).collect()}
    assert len(found) == 301 and found[303][0] == 4
    assert found == {i: (n, pytest.approx(x, abs=2e-6)) for i, (n, x) in expected.items()}
