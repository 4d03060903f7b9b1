"""Queries that select features, fit and score models, explain them, and choose experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.predictions import KEY_NAMES, key_description, normal_prediction
from ..operators import active, cluster, domain, explain, metrics, models, select, spanning, splits, structures, tuning
from ..sources import files, images, records, runs
from .registry import query, rounded, table
from .scalars import USERS, users

LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEYS = LINES.split(", ")


@query("SELECT * FROM (SELECT 'l_quantity' AS \"column\", round(var_pop(l_quantity), 6) AS variance FROM lineitem UNION ALL SELECT 'l_discount', round(var_pop(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(var_pop(l_tax), 6) FROM lineitem)")
def x02_variance(spark, sf_dir):
    return rounded(select.variances(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


COV = [("l_quantity", "l_quantity"), ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_extendedprice"), ("l_extendedprice", "l_discount"), ("l_discount", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) + 0.0 AS covariance FROM lineitem" for a, b in COV))
def x05_covariances(spark, sf_dir):
    return rounded(select.covariances(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS d, sign(corr(l_quantity, l_extendedprice)) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pow((l_quantity - a) / b + s * (l_extendedprice - c) / d, 2) / 2, 4) AS square FROM lineitem, m")
def x05_first_component(spark, sf_dir):
    """Of two standardised columns the first component is their sum or difference (by their correlation) over the root of two, up to its sign."""
    rows, _ = select.principal_components(table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 1)
    return rounded(rows.select(*LINE_KEYS, (F.col("PC1") * F.col("PC1")).alias("square")), 4)


@query()
def x05_principal_components(spark, sf_dir):
    rows, _ = select.principal_components(table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.9)
    return rounded(rows)


def _linear_weights(df, columns, target):
    z = select.assembled(metrics.standardise(df, columns), columns)
    return models.make("ridge", z, target).fit(z).coefficients.toArray()


@query()
def x04_elimination(spark, sf_dir):
    return select.eliminate(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", _linear_weights, keep=1)


def _two_lines_sql() -> str:
    """Elimination of one of two features (a, b) in each of three folds: by the larger weight of a fit on standardised features, scored with both and with one; then on all rows."""
    fit = "regr_count(y, a) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab, covar_pop(a, y) AS vay, covar_pop(b, y) AS vby"
    slopes = "(vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS sa, (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS sb, vay / vaa AS a1, vby / vbb AS b1"
    return (
        "WITH l AS (SELECT l_quantity AS a, l_linenumber::DOUBLE AS b, l_extendedprice AS y, ((row_number() OVER (ORDER BY md5('42:' || key), key) - 1) % 3) AS fold FROM "
        "(SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS key FROM lineitem)), "
        f"f AS (SELECT k.fold, {fit} FROM l, (SELECT DISTINCT fold FROM l) k WHERE l.fold <> k.fold GROUP BY 1), g AS (SELECT *, {slopes} FROM f), h AS (SELECT *, abs(sa) * sqrt(vaa) > abs(sb) * sqrt(vbb) AS keep_a FROM g), "
        "s AS (SELECT fold, 1 - sum(pow(y - my - sa * (a - ma) - sb * (b - mb), 2)) / (var_pop(y) * count(*)) AS two, 1 - sum(pow(y - my - CASE WHEN keep_a THEN a1 * (a - ma) ELSE b1 * (b - mb) END, 2)) / (var_pop(y) * count(*)) AS one FROM l JOIN h USING (fold) GROUP BY 1), "
        f"w AS (SELECT {slopes}, vaa, vbb FROM (SELECT {fit} FROM l)), t AS (SELECT avg(two) > avg(one) AS keep_both, any_value(abs(sa) * sqrt(vaa) > abs(sb) * sqrt(vbb)) AS keep_a FROM s, w) "
        "SELECT 'l_quantity' AS \"column\", CASE WHEN keep_both OR keep_a THEN 1 ELSE 2 END AS ranking FROM t UNION ALL SELECT 'l_linenumber', CASE WHEN keep_both OR NOT keep_a THEN 1 ELSE 2 END FROM t"
    )


@query(_two_lines_sql())
def x04_elimination_by_validation(spark, sf_dir):
    """The number of features by cross-validation, each fold eliminating for itself."""
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", *LINE_KEYS, F.round(F.col("l_extendedprice") * 100).cast("long")))
    lines = lines.select("l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber"), "l_extendedprice", "key")
    ranking, _ = models.eliminate_validated(lines, ["l_quantity", "l_linenumber"], "l_extendedprice", "key", "linear", k=3)
    return ranking


@query()
def x07_importance(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_tax"]
    return rounded(select.importance_table(table(spark, sf_dir, "lineitem"), columns, _linear_weights(table(spark, sf_dir, "lineitem"), columns, "l_extendedprice")), 4)


@query("SELECT event_id, round(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, (SELECT quantile_cont(value, 0.5) FROM events WHERE event_id % 7 <> 0)), 6) AS value, user_id::DOUBLE AS user_id FROM events")
def f00_feature_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "user_id", F.lit(1.0).alias("flat"), F.lit(None).cast("double").alias("gone"))
    return rounded(select.feature_table(e, "event_id"))


@query("SELECT o.o_orderkey, o.o_custkey, c.c_acctbal AS cust_c_acctbal FROM (SELECT o_orderkey, o_custkey FROM orders) o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = o.o_custkey")
def f14_merge_features(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return select.merge_features(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "cust_").select("o_orderkey", "o_custkey", "cust_c_acctbal")


@query("SELECT vec_id, list_concat([(x > 0)::INTEGER for x in embedding], [(x > 0.5)::INTEGER for x in embedding]) AS bits FROM embeddings")
def f09_concat_bits(spark, sf_dir):
    def bits(least: float):
        return F.transform("embedding", lambda x: (x > least).cast("int"))

    return table(spark, sf_dir, "embeddings").select("vec_id", structures.concat_bits(bits(0), bits(0.5)).alias("bits"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'e') THEN 'with e' ELSE 'Other' END AS class FROM part")
def f10_first_class(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", structures.first_class(name, {"red": name.contains("red"), "with e": name.contains("e")}).alias("class"))


@query("SELECT o_custkey AS sample, round(sum(o_totalprice), 4) AS energy, round(avg(o_totalprice / 1000), 9) AS force_mean, round(max(o_totalprice / 1000), 9) AS force_max, round(stddev_pop(o_totalprice / 1000), 9) AS force_std FROM orders GROUP BY 1")
def f07_sample_energies(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_totalprice").alias("energy"), (F.col("o_totalprice") / 1000).alias("force_norm"))
    out = structures.sample_energies(o, "sample")
    return rounded(out.drop("energy"), 9).join(rounded(out.select("sample", "energy"), 4), "sample")


@query("WITH v AS (SELECT vec_id, [abs(x)::DOUBLE for x in embedding] AS l FROM embeddings), s AS (SELECT vec_id, l, list_sum(l) AS t, list_avg(l) AS m FROM v) SELECT vec_id, len(l)::DOUBLE AS count, round(list_max(l), 6) AS max, round(m, 6) AS mean, round(t, 6) AS sum, round(sqrt(list_avg([(x - m) * (x - m) for x in l])), 6) AS std, round(-list_sum([x / t * ln(x / t + 1e-10) for x in l]), 6) AS entropy FROM s")
def f11_lifetimes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", structures.lifetimes(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("s"))
    return rounded(v.select("vec_id", "s.*"))


@query()
def f11_spanning_lifetimes(spark, sf_dir):
    """Statistics of the lengths at which the vectors of each label merge, in all components."""
    x = [f"x{i}" for i in range(64)]
    p = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(x)])
    return rounded(spanning.merge_statistics(p, "label", x))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0.0 AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def m07_standardise(spark, sf_dir):
    return rounded(metrics.standardise(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


PRED = "l_quantity * 1500"


@query(f"SELECT l_returnflag, round(1 - sum(pow(l_extendedprice - {PRED}, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(sqrt(avg(pow(l_extendedprice - {PRED}, 2))), 6) AS rmse, round(avg(abs(l_extendedprice - {PRED})), 6) AS mae FROM lineitem GROUP BY 1")
def m09_scores(spark, sf_dir):
    return rounded(metrics.scores(table(spark, sf_dir, "lineitem").withColumn("p", F.expr(PRED)), "l_extendedprice", "p", ["l_returnflag"]))


@query(f"SELECT round(l_extendedprice, 6) AS \"True_Value\", round({PRED}, 6) AS \"Predicted_Value\", round(l_extendedprice - {PRED}, 6) + 0.0 AS \"Residual\" FROM lineitem")
def m10_residuals(spark, sf_dir):
    return rounded(metrics.residuals(table(spark, sf_dir, "lineitem").withColumn("p", F.expr(PRED)), "l_extendedprice", "p"))


@query("SELECT n::BIGINT AS n, [round(n * (0.2 + 0.8 * i / (p - 1)))::INTEGER for i in range(p)] AS sizes FROM (SELECT n, least(20, greatest(8, round(n / 80)))::INTEGER AS p FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment UNION ALL SELECT count(*) FROM supplier))")
def m11_curve_sizes(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).select("n").union(table(spark, sf_dir, "supplier").agg(F.count("*")))
    return spark.createDataFrame([(r["n"], splits.curve_sizes(r["n"])) for r in counts.collect()], "n long, sizes array<int>")


@query(f"WITH s AS (SELECT *, (c_custkey % 4 = 0) AS test, row_number() OVER (PARTITION BY c_custkey % 4 = 0 ORDER BY md5('42:' || c_custkey::VARCHAR), c_custkey) AS k, count(*) OVER (PARTITION BY c_custkey % 4 = 0) AS n FROM customer), z AS (SELECT p, round((SELECT n FROM s WHERE NOT test LIMIT 1) * p)::INTEGER AS size FROM (SELECT unnest([0.2, 0.6, 1.0]) AS p)), f AS (SELECT size, regr_slope(c_acctbal, c_nationkey) AS a, regr_intercept(c_acctbal, c_nationkey) AS b FROM s, z WHERE NOT test AND k <= size GROUP BY size) SELECT size AS train_size, round(sqrt(avg(pow(c_acctbal - a * c_nationkey - b, 2))), 4) AS rmse, round(avg(abs(c_acctbal - a * c_nationkey - b)), 4) AS mae FROM f, s WHERE test GROUP BY size")
def m11_learning_curve(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), "c_acctbal")
    fitted, held = c.where("c_custkey % 4 <> 0"), c.where("c_custkey % 4 = 0")
    n = fitted.count()
    return rounded(models.learning_curve(fitted, held, ["x"], "c_acctbal", "c_custkey", [round(n * p) for p in (0.2, 0.6, 1.0)], "linear").select("train_size", "rmse", "mae"), 4)


@query("WITH r AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'rmse' ELSE 'mae' END || '_' || vec_id::VARCHAR AS long_name, vec_id, unnest(range(1, 65))::INTEGER AS step, unnest(embedding)::DOUBLE AS value FROM embeddings), n AS (SELECT vec_id::VARCHAR || CASE WHEN vec_id % 2 = 0 THEN '_rmse' ELSE '_mae' END AS name, step, value FROM r) SELECT step, name, round(value, 9) + 0.0 AS value FROM n UNION ALL SELECT step, regexp_replace(name, 'rmse$', 'mse'), round(value * value, 9) FROM n WHERE suffix(name, 'rmse')")
def m13_history_table(spark, sf_dir):
    name = F.concat(F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 2 == 0, "_rmse").otherwise("_mae"))
    return rounded(metrics.history_table(table(spark, sf_dir, "embeddings").select(name.alias("name"), F.col("embedding").cast("array<double>").alias("values"))), 9)


@query("SELECT o_custkey, round(avg(p), 6) AS p, round(any_value(y), 6) AS y FROM (SELECT o_custkey, o_totalprice AS p, o_custkey * 2.0::DOUBLE AS y FROM orders) GROUP BY 1")
def m06_out_of_fold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("p"), (F.col("o_custkey") * 2.0).alias("y"))
    return rounded(splits.out_of_fold(o, "o_custkey", "p", "y").select("o_custkey", "p", "y"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def a01_linear(spark, sf_dir):
    data = select.assembled(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"])
    m = models.make("linear", data, "l_extendedprice").fit(data)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 3), round(float(m.intercept), 2))], "slope double, intercept double")


@query("WITH c AS (SELECT l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS x, l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM lineitem) SELECT round(sum(x * y) / (sum(x * x) + 1000), 3) AS slope FROM c")
def a02_ridge(spark, sf_dir):
    data = select.assembled(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"])
    m = models.make("ridge", data, "l_extendedprice", alpha=1000.0).fit(data)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 3),)], "slope double")


@query("WITH c AS (SELECT l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS x, l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM lineitem), m AS (SELECT avg(x * y) AS xy, avg(x * x) AS xx FROM c) SELECT round(sign(xy) * greatest(abs(xy) - 500, 0) / xx, 2) AS slope FROM m")
def a03_lasso(spark, sf_dir):
    data = select.assembled(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"])
    m = models.make("lasso", data, "l_extendedprice", alpha=500.0).fit(data)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 2),)], "slope double")


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice", F.dayofmonth("o_orderdate").cast("double").alias("day"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_custkey") % 100).cast("double").alias("kind"))


def _trained(name: str, **params):
    def run(spark, sf_dir):
        _, _, both = models.train(_orders(spark, sf_dir), ["day", "month", "kind"], "o_totalprice", "o_orderkey", name, **params)
        return both

    run.__name__ = f"a_{name}"
    run.__doc__ = f"Scores of a {name} model on both sides of a split."
    query()(run)


for _name, _params in (("elastic_net", {}), ("decision_tree", {}), ("random_forest", {"numTrees": 10}), ("extra_trees", {"numTrees": 10}), ("gbdt", {"maxIter": 5}), ("adaboost", {"rounds": 3}), ("svr", {"features": 20}), ("mlp", {"epochs": 5}), ("pinn", {"epochs": 3})):
    _trained(_name, **_params)


def _folds_sql(fold: str) -> str:
    """Scores of a line fitted outside each fold."""
    return f"WITH o AS (SELECT o_orderkey, o_totalprice AS y, month(o_orderdate)::DOUBLE AS x, {fold} AS fold FROM orders), f AS (SELECT k.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM o, (SELECT DISTINCT fold FROM o) k WHERE o.fold <> k.fold GROUP BY 1) SELECT fold, round(1 - sum(pow(y - a * x - b, 2)) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg(pow(y - a * x - b, 2))), 4) AS rmse, round(avg(abs(y - a * x - b)), 4) AS mae FROM o JOIN f USING (fold) GROUP BY 1"


@query(_folds_sql("((row_number() OVER (ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) - 1) % 3)::INTEGER"))
def m06_cross_validation(spark, sf_dir):
    _, by_fold = models.cross_validate(_orders(spark, sf_dir), ["month"], "o_totalprice", "o_orderkey", "linear", 3)
    return rounded(by_fold, 4)


@query(_folds_sql("((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) - 1) % 3)::INTEGER"))
def m06_stratified_validation(spark, sf_dir):
    o = _orders(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    _, by_fold = models.cross_validate(o, ["month"], "o_totalprice", "o_orderkey", "linear", 3, stratum="o_orderstatus")
    return rounded(by_fold, 4)


@query(_folds_sql("(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END)::INTEGER"))
def m06_group_validation(spark, sf_dir):
    """Whole priorities held out, in folds that are given."""
    fold = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    o = _orders(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", fold.alias("fold")), "o_orderkey")
    _, by_fold = models.cross_validate(o, ["month"], "o_totalprice", "o_orderkey", "linear", fold="fold")
    return rounded(by_fold, 4)


def _repeated_sql(repeat: int) -> str:
    part = _folds_sql(f"((row_number() OVER (ORDER BY md5('{42 + repeat}:' || o_orderkey::VARCHAR), o_orderkey) - 1) % 3)::INTEGER")
    return f"SELECT {repeat} AS repeat, * FROM ({part})"


@query(_repeated_sql(0) + " UNION ALL " + _repeated_sql(1))
def m06_repeated_validation(spark, sf_dir):
    """Two repeats of three folds."""
    _, by_fold = models.cross_validate(_orders(spark, sf_dir), ["month"], "o_totalprice", "o_orderkey", "linear", 3, repeats=2)
    return rounded(by_fold, 4)


@query("SELECT o_custkey, count(DISTINCT o_custkey) AS folds FROM orders GROUP BY 1")
def m06_group_folds(spark, sf_dir):
    """Each customer lies in one fold."""
    f = splits.group_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)
    return f.groupBy("o_custkey").agg(F.countDistinct("fold").alias("folds"))


@query("WITH c AS (SELECT l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS x, l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM lineitem), m AS (SELECT avg(x * y) AS xy, avg(x * x) AS xx FROM c) SELECT round(sign(xy) * greatest(abs(xy) - 250, 0) / (xx + 250), 2) AS slope FROM m")
def a04_elastic_net(spark, sf_dir):
    data = select.assembled(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"])
    m = models.make("elastic_net", data, "l_extendedprice", alpha=500.0, l1_ratio=0.5).fit(data)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 2),)], "slope double")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(avg(l_extendedprice) OVER (PARTITION BY l_linenumber > 3), 2) AS prediction FROM lineitem")
def a05_tree_stump(spark, sf_dir):
    """A tree of one split on a feature of two values predicts the mean of each side."""
    data = select.assembled(table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_extendedprice", (F.col("l_linenumber") > 3).cast("double").alias("late")), ["late"])
    m = models.make("decision_tree", data, "l_extendedprice", maxDepth=1).fit(data)
    return rounded(m.transform(data).select(*LINE_KEYS, "prediction"), 2)


@query()
def h01_search(spark, sf_dir):
    """Twelve trials of an elastic net, the last two by Parzen densities; validated on three folds."""
    return rounded(tuning.search(_orders(spark, sf_dir), ["day", "month", "kind"], "o_totalprice", "o_orderkey", "elastic_net", trials=12))


@query("SELECT " + LINES + ", round(1500 * (l_quantity - (SELECT avg(l_quantity) FROM lineitem)), 4) + 0.0 AS l_quantity, round(-20 * (l_discount - (SELECT avg(l_discount) FROM lineitem)), 4) + 0.0 AS l_discount FROM lineitem")
def e01_linear_contributions(spark, sf_dir):
    return rounded(explain.linear_contributions(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], [1500.0, -20.0], LINE_KEYS), 4)


@query("WITH s AS (SELECT l_linenumber > 3 AS late, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(avg(l_extendedprice) OVER (PARTITION BY late) - avg(l_extendedprice) OVER (), 2) + 0.0 AS late, 0.0::DOUBLE AS l_tax, round(avg(l_extendedprice) OVER (), 2) AS base FROM s")
def e01_tree_contributions(spark, sf_dir):
    """Of a tree with one split all of a prediction's distance to the mean is the split feature's."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, "l_extendedprice", (F.col("l_linenumber") > 3).cast("double").alias("late"), "l_tax")
    fitted = models.make("decision_tree", lines, "l_extendedprice", maxDepth=1).fit(select.assembled(lines.select("late", F.lit(0.0).alias("l_tax"), "l_extendedprice"), ["late", "l_tax"]))
    return rounded(explain.tree_contributions(lines, fitted, ["late", "l_tax"], LINE_KEYS), 2)


@query()
def e01_forest_contributions(spark, sf_dir):
    """Exact contributions to a forest's predictions; with the base they add up to these."""
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEYS[:1], *LINE_KEYS[2:], "l_extendedprice", *(F.col(c).cast("double").alias(c) for c in columns))
    data = select.assembled(lines, columns)
    fitted = models.make("random_forest", data, "l_extendedprice", numTrees=10, maxDepth=4).fit(data)
    return rounded(explain.tree_contributions(data, fitted, columns, ["l_orderkey", "l_partkey", "l_suppkey", "prediction"], "prediction"), 4)


@query()
def e02_permutation_importance(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return explain.permutation_importance(o, ["day", "month"], "o_totalprice", "o_orderkey", lambda d: d.withColumn("prediction", F.col("month") * 1000 + 200_000), repeats=2)


@query("SELECT p_brand AS \"column\", round(avg(p_retailprice), 6) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def e03_top_importances(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("column")).agg(F.round(F.avg("p_retailprice"), 6).alias("importance"))
    return explain.top_importances(p, 15)


@query("WITH m AS (SELECT avg(c_nationkey) AS a, avg(c_acctbal) AS b FROM customer) SELECT c_custkey, 'n' AS \"column\", round(30 * (c_nationkey - a), 4) + 0.0 AS value FROM customer, m UNION ALL SELECT c_custkey, 'c_acctbal', round(-0.5 * (c_acctbal - b), 4) + 0.0 FROM customer, m")
def e01_sampled_shapley(spark, sf_dir):
    """Of a linear model sampled values are exact in every order, so SQL can say them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("n"), "c_acctbal")
    return rounded(explain.sampled_shapley(c, ["n", "c_acctbal"], "c_custkey", lambda d: d.withColumn("prediction", F.col("n") * 30 - F.col("c_acctbal") * 0.5 + 7), orders=4), 4)


@query("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT p_partkey, round(a * p_size + b, 2) AS prediction FROM part, f")
def r01_predict(spark, sf_dir):
    """A model of prices by quantity, fitted on lines, applied to rows of another table that lack a fingerprint column."""
    lines = select.assembled(table(spark, sf_dir, "lineitem").select("l_extendedprice", F.col("l_quantity").alias("q"), F.lit(0.0).alias("fp_1")), ["q", "fp_1"])
    fitted = models.make("linear", lines, "l_extendedprice").fit(lines)
    return rounded(models.predict(fitted, table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("q")), ["q", "fp_1"], pad=True).select("p_partkey", "prediction"), 2)


BITS = "SELECT vec_id, [(x > 0)::INTEGER for x in embedding] AS b FROM embeddings"
PAIRED = f"WITH b AS ({BITS}), s AS (SELECT q.vec_id, t.vec_id AS train_vec_id, list_sum([q.b[i] * t.b[i] for i in range(1, 65)]) AS i, list_sum(q.b) + list_sum(t.b) AS n FROM b q JOIN b t ON q.vec_id % 20 = 0 AND t.vec_id % 20 <> 0), j AS (SELECT vec_id, train_vec_id, CASE WHEN n = i THEN 0 ELSE i / (n - i) END::DOUBLE AS similarity FROM s)"


@query(PAIRED + " SELECT vec_id, train_vec_id, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, train_vec_id))::INTEGER AS rank FROM j QUALIFY rank <= 5")
def d02_most_similar(spark, sf_dir):
    """The stated query set (every twentieth) against all other rows."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(domain.most_similar(e.where("vec_id % 20 = 0"), e.where("vec_id % 20 <> 0"), "vec_id", "embedding", 5))


@query(PAIRED + " SELECT vec_id, round(max(similarity), 6) AS sim_max, max(similarity) >= 0.25 AS in_domain FROM j GROUP BY 1")
def d03_in_domain(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(domain.in_domain(e.where("vec_id % 20 = 0"), e.where("vec_id % 20 <> 0"), "vec_id", "embedding"))


@query()
def d01_hull(spark, sf_dir):
    """Each twentieth vector against the hull of all others in the plane of their first two components, of all 64 columns."""
    x = [f"x{i}" for i in range(64)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(x)))
    return rounded(domain.component_domain(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), x))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def s06_pool(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("y"))
    return active.pool(o, "y")[1].select("o_orderkey")


@query(f"SELECT user_id, round(mu, 6) AS al_mu, round(sigma, 6) AS al_sigma, round(mu + 2 * sigma, 6) AS al_acq FROM ({USERS}) ORDER BY mu + 2 * sigma DESC, user_id LIMIT 10")
def l02_recommend(spark, sf_dir):
    u = users(spark, sf_dir).select("user_id", F.col("mu").alias("al_mu"), F.col("sigma").alias("al_sigma"))
    return rounded(active.recommend(u, "user_id", "ucb"))


@query()
def l01_gaussian_process(spark, sf_dir):
    s = select.assembled(table(spark, sf_dir, "supplier").withColumn("x", F.col("s_nationkey").cast("double")), ["x"])
    measured = F.crc32(F.col("s_suppkey").cast("string")) % 2 == 0
    return active.gaussian_process(s.where(measured), s.where(~measured), "s_acctbal").select("s_suppkey", "al_mu", "al_sigma")


@query()
def c15_clusters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("n"))
    return cluster.cluster(c, ["c_acctbal", "n"], most=4)[0]


@query()
def c18_augment(spark, sf_dir):
    return cluster.augment(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 500)


@query("SELECT 'img/' || p_partkey || '.png' AS path, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE '<start> ' || p_name || ' <end>' END AS caption FROM part")
def s08_captions(spark, sf_dir):
    from ..sources.files import captions

    folder = f"{runs_folder(spark)}/captions"
    line = F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat_ws(",", "p_partkey", "p_name"))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(folder)
    return captions(spark, folder, "img/")


def runs_folder(spark) -> str:
    """A new folder in the shared place."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder: executors need one that all of them share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/forgeframe/{uuid.uuid4().hex}"


@query("SELECT c_custkey, try_cast(nullif(regexp_extract(c_name, '(\\d+)', 1), '') AS BIGINT) AS number FROM customer")
def s09_natural_order(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", files.natural_order(F.col("c_name")).alias("number"))


@query("SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / (n // (n // 128)))::INTEGER AS shard FROM orders, (SELECT count(*) AS n FROM orders) QUALIFY shard < n // 128")
def k08_record_shards(spark, sf_dir):
    return files.record_shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 128)


@query("SELECT doc_id, text, n_chars::BIGINT AS n_chars FROM documents")
def k08_record_files(spark, sf_dir):
    """All documents as checksummed record files of some 128 each, read back with every checksum verified."""
    folder = f"{runs_folder(spark)}/records"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    records.write_records(files.record_shards(docs, "doc_id", files.RECORDS, keep_rest=True), folder, "shard")
    return records.read_records(spark, folder, "doc_id long, text string, n_chars long")


@query("WITH v AS (SELECT vec_id, i, least(greatest(floor((embedding[i] + 2) * 64), 0), 255)::INTEGER AS p FROM embeddings, unnest(range(1, 65)) AS t(i)), b AS (SELECT vec_id, min((i - 1) // 8) AS top, max((i - 1) // 8) AS bottom, min((i - 1) % 8) AS l, max((i - 1) % 8) AS r FROM v WHERE p <= 200 GROUP BY 1), s AS (SELECT vec_id, bottom - top + 1 AS h, r - l + 1 AS w, greatest(floor(1.2 * greatest(bottom - top + 1, r - l + 1)), 9)::INTEGER AS side, top, bottom, l, r FROM b) SELECT s.vec_id, any_value(side) AS side, (sum(least(floor(p * 1.6), 255)) + (any_value(side * side - h * w)) * 255)::BIGINT AS total FROM s JOIN v ON v.vec_id = s.vec_id AND (i - 1) // 8 BETWEEN top AND bottom AND (i - 1) % 8 BETWEEN l AND r GROUP BY 1")
def f15_squared_images(spark, sf_dir):
    """Vectors as images of eight by eight, trimmed, laid in a white square, brightened: side and sum of all pixels."""
    single = lambda n: F.lit(n).cast("float")  # noqa: E731  the vectors are of single precision, and so is what SQL makes of them: whole numbers would widen them
    value = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x + single(2)) * single(64)), F.lit(0)), F.lit(255)).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", value.alias("v")).withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, F.lit(8))))
    e = e.withColumn("p", images.trimmed(F.col("p"))).withColumn("p", images.squared(F.col("p"), least=9)).withColumn("p", images.enhanced(F.col("p"), 0, 1.6))
    total = F.aggregate(F.flatten("p"), F.lit(0).cast("long"), lambda a, v: a + v)
    return e.select("vec_id", F.size("p").alias("side"), total.alias("total"))


@query("SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 400)::INTEGER AS chunk FROM orders, (SELECT count(*) AS n FROM orders) QUALIFY chunk < n // 400")
def k09_caption_chunks(spark, sf_dir):
    return files.caption_chunks(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 400)


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, w LIMIT 500")
def t20_vocabulary(spark, sf_dir):
    from ..operators.vocabulary import vocabulary

    return vocabulary(table(spark, sf_dir, "documents"), "text", 500).select("word", "n")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'O') AS warning, count(*) FILTER (o_orderstatus = 'P') AS error FROM orders")
def g01_step_counts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "warning").otherwise("error")
    return runs.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id"), status.alias("status")))


@query("SELECT strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey::VARCHAR AS run_id FROM orders ORDER BY 1 DESC LIMIT 200")
def s11_list_runs(spark, sf_dir):
    """A top-k report: the newest runs by id."""
    return runs.list_runs(table(spark, sf_dir, "orders").select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string")).alias("run_id")), 200)


@query("SELECT o_orderkey AS step_id, '{\"step_id\":' || o_orderkey::VARCHAR || ',\"operation\":\"' || o_orderpriority || '\"}' AS json FROM orders")
def k03_steps_json(spark, sf_dir):
    return runs.steps_json(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id"), F.col("o_orderpriority").alias("operation")))


@query(r"WITH v AS (SELECT w, (row_number() OVER (ORDER BY n DESC, w) + 1)::INTEGER AS id FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, w LIMIT 50)), m AS (SELECT map_from_entries(list((w, id))) AS m FROM v), d AS (SELECT p_partkey, [coalesce(m[w], 1) for w in list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: x <> '')] AS ids FROM part, m) SELECT p_partkey, list_concat(ids[1:4], [0 for i in range(greatest(0, 4 - len(ids)))])::INTEGER[] AS ids FROM d")
def t20_encode(spark, sf_dir):
    from ..operators.vocabulary import encode, vocabulary

    words = vocabulary(table(spark, sf_dir, "documents"), "text", 50)
    return encode(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", words, 4).select("p_partkey", F.col("ids").cast("array<int>").alias("ids"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, k <= n - n // 5 AS train FROM r")
def t20_train_validation(spark, sf_dir):
    from ..operators.vocabulary import train_validation

    o = table(spark, sf_dir, "orders").select("o_orderkey")
    n = o.count()
    first, rest = train_validation(o, "o_orderkey", n - n // 5)
    return first.withColumn("train", F.lit(True)).unionByName(rest.withColumn("train", F.lit(False)))


KEYS = ", ".join(f"({n}, '{name}')" for n, name in KEY_NAMES.items())


@query(f"SELECT p_partkey, CASE WHEN p_size > 45 THEN 'Invalid Key' ELSE coalesce(k.name, 'Unknown Fragment') END AS name FROM part LEFT JOIN (VALUES {KEYS}) k(n, name) ON k.n = p_partkey % 170")
def t19_key_descriptions(spark, sf_dir):
    """All numbers up to some beyond the last key, and texts that are no numbers."""
    key = F.when(F.col("p_size") > 45, F.col("p_name")).otherwise((F.col("p_partkey") % 170).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", key_description(key).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'C' || (p_size % 10)::VARCHAR || 'O' END AS structure, round(CASE p_partkey % 4 WHEN 0 THEN p_size / 100 WHEN 1 THEN p_size / 50 WHEN 2 THEN (1 + p_size / 100 + 0.5) / 3 END, 6) AS confidence FROM part")
def t18_normal_predictions(spark, sf_dir):
    """A text with its confidence, candidates, tokens, nothing."""
    size, kind = F.col("p_size").cast("double"), F.col("p_partkey") % 4

    def part(text, confidence):
        return F.struct(text.alias("text"), confidence.alias("confidence"))

    tokens = F.array(part(F.lit("C"), F.lit(1.0)), part((F.col("p_size") % 10).cast("string"), size / 100), part(F.lit("O"), F.lit(0.5)))
    parts = F.when(kind == 1, F.array(part(F.col("p_name"), size / 50), part(F.lit("second"), F.lit(0.1)))).when(kind == 2, tokens)
    answer = normal_prediction(F.when(kind == 0, F.col("p_name")), F.when(kind == 0, size / 100), parts)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", answer.alias("a")).select("p_partkey", "a.structure", "a.confidence"))
