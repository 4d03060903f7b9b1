"""Queries that clean, encode and sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean as C
from ..operators import splits as S
from .profiling import HOLES, holes
from .registry import query, rounded, table

NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"


@query(rf"WITH f AS (SELECT * FROM part ORDER BY p_partkey LIMIT 200), b AS (SELECT 'p_name' AS c, count(try_cast(nullif(regexp_extract(p_name, '{NUMBER}'), '') AS DOUBLE)) / count(*) AS s FROM f UNION ALL SELECT 'p_brand', count(try_cast(nullif(regexp_extract(p_brand, '{NUMBER}'), '') AS DOUBLE)) / count(*) FROM f UNION ALL SELECT 'p_type', count(try_cast(nullif(regexp_extract(p_type, '{NUMBER}'), '') AS DOUBLE)) / count(*) FROM f) SELECT c AS \"column\", 'regex_number' AS method FROM b WHERE s >= 0.5".replace('\\"', '"'))
def c01_pseudo_numeric(spark, sf_dir):
    return C.pseudo_numeric(table(spark, sf_dir, "part"), "p_partkey")


@query(rf"SELECT p_partkey, try_cast(nullif(regexp_extract(p_brand, '{NUMBER}'), '') AS DOUBLE) AS p_brand FROM part")
def c02_to_numbers(spark, sf_dir):
    return C.to_numbers(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), {"p_brand": "regex_number"})


def _fill(spark, sf_dir, strategy, value=None):
    return rounded(C.fill_missing(holes(spark, sf_dir).select("event_id", "value"), strategy, ["value"], value))


@query(f"WITH e AS ({HOLES}) SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 6) AS value FROM e")
def c03_fill_median(spark, sf_dir):
    return _fill(spark, sf_dir, "median")


@query(f"WITH e AS ({HOLES}) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) AS value FROM e")
def c03_fill_mean(spark, sf_dir):
    return _fill(spark, sf_dir, "mean")


@query(f"WITH e AS ({HOLES}) SELECT event_id, round(coalesce(value, (SELECT value FROM e WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)), 6) AS value FROM e")
def c03_fill_mode(spark, sf_dir):
    return _fill(spark, sf_dir, "mode")


@query(f"WITH e AS ({HOLES}) SELECT event_id, round(coalesce(value, -1), 6) AS value FROM e")
def c03_fill_constant(spark, sf_dir):
    return _fill(spark, sf_dir, "constant", -1.0)


@query(f"WITH e AS ({HOLES}) SELECT event_id, round(value, 6) AS value, event_type, user_id FROM e WHERE value IS NOT NULL AND event_type IS NOT NULL")
def c03_drop_rows(spark, sf_dir):
    return rounded(C.fill_missing(holes(spark, sf_dir), "drop_rows"))


@query(f"WITH e AS ({HOLES}) SELECT event_id, coalesce(event_type, (SELECT event_type FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 6) AS value FROM e")
def c04_clean_missing(spark, sf_dir):
    return rounded(C.clean_missing(holes(spark, sf_dir).select("event_id", "event_type", "value"), "median", columns=["value"]))


@query("WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS r FROM part), d AS (SELECT g.p_partkey, d.r, row_number() OVER (PARTITION BY g.p_partkey ORDER BY sqrt(2.0 * (g.s - d.s) * (g.s - d.s)), d.p_partkey) AS k FROM p g JOIN p d ON g.p_partkey <> d.p_partkey WHERE g.r IS NULL AND d.r IS NOT NULL) SELECT p.p_partkey, p.s, round(coalesce(p.r, (SELECT avg(d.r) FROM d WHERE d.p_partkey = p.p_partkey AND k <= 5)), 6) AS r FROM p")
def c05_knn_impute(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("r"))
    return rounded(C.knn_impute(p, "p_partkey", ["s", "r"], 5).select("p_partkey", "s", "r"))


IQR = "SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, quantile_cont({c}, 0.5) AS m, avg({c}) AS u, stddev_pop({c}) AS sp, stddev_samp({c}) AS ss FROM {t}"
IQR_O, IQR_V, IQR_C = (IQR.format(c=c, t=t) for c, t in (("o_totalprice", "orders"), ("value", "events"), ("c_acctbal", "customer")))


@query(f"WITH f AS ({IQR_V}) SELECT 'value' AS \"column\", count(*) AS n_outliers FROM events, f WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) HAVING count(*) > 0")
def c06_outliers_iqr(spark, sf_dir):
    return C.detect_outliers(table(spark, sf_dir, "events"), ["value"], "iqr", 1.5)


@query(f"WITH f AS ({IQR_V}) SELECT 'value' AS \"column\", count(*) AS n_outliers FROM events, f WHERE abs(value - u) / sp > 2 HAVING count(*) > 0")
def c06_outliers_zscore_pop(spark, sf_dir):
    return C.detect_outliers(table(spark, sf_dir, "events"), ["value"], "zscore_pop", 2.0)


@query(f"WITH f AS ({IQR_V}) SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) AS value FROM events, f")
def c07_clip(spark, sf_dir):
    return rounded(C.treat_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"], "clip"))


@query(f"WITH f AS ({IQR_V}) SELECT event_id, round(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN m ELSE value END, 6) AS value FROM events, f")
def c07_replace_median(spark, sf_dir):
    return rounded(C.treat_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"], "replace_median"))


@query(f"WITH f AS ({IQR_C}) SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer, f WHERE abs(c_acctbal - u) / ss <= 1.5")
def c08_remove_zscore_samp(spark, sf_dir):
    return rounded(C.treat_outliers(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "remove", "zscore_samp", 1.5, skip_flat=True))


@query("SELECT DISTINCT text, lang FROM documents")
def c09_drop_duplicates(spark, sf_dir):
    return C.drop_duplicates(table(spark, sf_dir, "documents").select("text", "lang"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 9 = 0 THEN NULL ELSE 'same' END AS kind FROM events), c AS (SELECT kind, count(*) AS n, min(event_id) AS f FROM e WHERE kind IS NOT NULL GROUP BY 1) SELECT 'kind' AS \"column\", kind AS value, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c WHERE n / (SELECT sum(n) FROM c) >= 0.6 ORDER BY n DESC, f LIMIT 1")
def c10_high_repetition(spark, sf_dir):
    kind = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise("same")
    return rounded(C.high_repetition(table(spark, sf_dir, "events").select("event_id", kind.alias("kind")), ["kind"], 0.6, "event_id"))


RANKED = "row_number() OVER (PARTITION BY {p} ORDER BY md5('42:' || {k}::VARCHAR), {k})"


@query("WITH t AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 1), r AS (SELECT e.*, t.n, event_type = t.v AS top, " + RANKED.format(p="event_type = t.v", k="event_id") + " AS k, (SELECT count(*) FROM events) AS a FROM events e, t) SELECT event_id, event_type FROM r WHERE NOT top OR n <= floor((a - n) * 0.15 / 0.85) OR k <= floor((a - n) * 0.15 / 0.85)")
def c11_reduce_repetition(spark, sf_dir):
    return C.reduce_repetition(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 0.15)


@query(f"WITH e AS ({HOLES}) SELECT event_id, event_type FROM (SELECT *, " + RANKED.format(p="event_type", k="event_id") + " AS k FROM e WHERE event_type IS NOT NULL) WHERE k <= 300")
def c12_balance(spark, sf_dir):
    return C.balance_categories(holes(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", 300)


@query("WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders) SELECT o_custkey, round(quantile_cont(p, 0.5), 6) AS price, count(p) AS price_rep_n, round(stddev_samp(p), 6) AS price_rep_std, arg_min(s, o_orderkey) FILTER (s IS NOT NULL) AS status, min(o_orderkey) AS o_orderkey FROM o GROUP BY 1 HAVING count(p) > 0")
def c13_aggregate_by_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))
    return rounded(C.aggregate_by_keys(o, ["o_custkey"], "price", "o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'A' AS \"l_returnflag_A\", l_returnflag = 'N' AS \"l_returnflag_N\", l_returnflag = 'R' AS \"l_returnflag_R\" FROM lineitem")
def c14_one_hot(spark, sf_dir):
    return C.one_hot(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_returnflag")


@query(r"""SELECT p_partkey, nullif(trim(regexp_replace(trim(p_name), '^"(.*)"$', '\1')), '') AS p_name FROM part WHERE p_partkey % 3 <> 0""")
def c16_clean_structures(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(' "'), "p_name", F.lit('" '))).otherwise("N/A").alias("p_name"))
    return C.clean_structures(p, ["p_name"], X.clean_raw, drop_invalid=True)


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) AS value FROM e")
def c17_repair_infinite(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return rounded(C.repair_infinite(e, ["value"]))


@query("SELECT n_nationkey, n_name, n_regionkey, NULL::INTEGER AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def c19_union(spark, sf_dir):
    return C.union_all(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))


@query("SELECT p_partkey, p_name FROM part")
def c20_drop_prefixed(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").alias("fp_1"), F.col("p_size").alias("fp_2"))
    return C.drop_prefixed(p, ("fp_",))


@query("SELECT event_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events WHERE event_type IN ('click', 'purchase', 'view'))")
def c21_preferred_value(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return e.where(F.col("event_type") == F.lit(C.prefer(e, "event_type", ["click", "purchase", "view"])))


ORDER_RANK = "row_number() OVER (ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey)"


@query(f"SELECT o_orderkey, {ORDER_RANK} <= ceil((SELECT count(*) FROM orders) * 0.2) AS is_test FROM orders")
def m02_random_split(spark, sf_dir):
    return S.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2)


BINS = "SELECT o_orderkey, greatest((o_totalprice > q1)::INTEGER + (o_totalprice > q2)::INTEGER + (o_totalprice > q3)::INTEGER, 0) AS bin FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)"


@query(BINS)
def m03_quantile_bins(spark, sf_dir):
    return S.quantile_bins(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 4).drop("o_totalprice")


@query(f"WITH b AS ({BINS}), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) AS k, count(*) OVER (PARTITION BY bin) AS n FROM b) SELECT o_orderkey, bin, k <= floor(n * 0.2 + 0.5) AS is_test FROM r")
def m04_stratified_split(spark, sf_dir):
    return S.stratified_split(m03_quantile_bins(spark, sf_dir), "bin", "o_orderkey", 0.2)


@query("WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_custkey::VARCHAR), o_custkey) <= ceil((SELECT count(DISTINCT o_custkey) FROM orders) * 0.2) AS is_test FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, o_custkey, is_test FROM orders JOIN g USING (o_custkey)")
def m05_group_split(spark, sf_dir):
    return S.group_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2)


@query(f"SELECT o_orderkey, (({ORDER_RANK} - 1) % 5)::INTEGER AS fold FROM orders")
def m06_folds(spark, sf_dir):
    return S.folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"WITH r AS (SELECT o_orderkey, {ORDER_RANK} AS k FROM orders) SELECT o_orderkey, unnest(list_filter([20, 50, 100], lambda s: k <= s))::INTEGER AS size FROM r")
def m11_nested_prefixes(spark, sf_dir):
    return S.nested_prefixes(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [20, 50, 100])
