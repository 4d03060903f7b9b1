"""Queries that profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from .registry import query, rounded, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Events with holes: no test table has any.
HOLES = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, user_id FROM events"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "user_id")


@query(f"WITH e AS ({HOLES}) SELECT count(*) AS n_rows, 4 AS n_columns, 3 AS n_numeric, 1 AS n_other, (count(*) * 4 - count(event_id) - count(event_type) - count(value) - count(user_id))::BIGINT AS n_missing FROM e")
def p01_summary(spark, sf_dir):
    return P.summary(holes(spark, sf_dir))


def _each(sql: str, columns: list[str], frm: str) -> str:
    return " UNION ALL ".join(sql.format(c=c) + f" FROM {frm}" for c in columns)


DESCRIBED = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c} + 0.0), 6) + 0.0 AS min, round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS q50, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75, round(max({c} + 0.0), 6) AS max"


@query(_each(DESCRIBED, MEASURES, "lineitem"))
def p02_describe_lineitem(spark, sf_dir):
    return rounded(P.describe(table(spark, sf_dir, "lineitem"), MEASURES))


@query(f"WITH e AS ({HOLES}) SELECT * FROM (SELECT 'event_type' AS \"column\", count(*) - count(event_type) AS n_missing, round((count(*) - count(event_type)) * 100.0 / count(*), 6)::DOUBLE AS missing_percent FROM e UNION ALL SELECT 'value', count(*) - count(value), round((count(*) - count(value)) * 100.0 / count(*), 6)::DOUBLE FROM e) WHERE n_missing > 0")
def p03_missing_table(spark, sf_dir):
    return rounded(P.missing_table(holes(spark, sf_dir)))


PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a, b in PAIRS)


@query(CORR)
def p04_correlations(spark, sf_dir):
    return rounded(P.correlations(table(spark, sf_dir, "lineitem"), MEASURES))


GROSS = "l_extendedprice * (1 + l_tax) + l_quantity"
HIGH = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM (SELECT *, {GROSS} AS gross FROM lineitem)" for a, b in [*PAIRS, *((m, "gross") for m in MEASURES)])


@query(f"SELECT * FROM ({HIGH}) WHERE abs(r) >= 0.8")
def p05_high_correlations(spark, sf_dir):
    """Among the measures and a price with tax, which follows the price closely."""
    return rounded(P.high_correlations(table(spark, sf_dir, "lineitem").withColumn("gross", F.expr(GROSS)), [*MEASURES, "gross"], 0.8))


@query("SELECT * FROM (" + _each("SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) + 0.0 AS r", ["l_quantity", "l_discount", "l_tax"], "lineitem") + ") ORDER BY abs(r) DESC, \"column\" LIMIT 2")
def p06_target_correlations(spark, sf_dir):
    return rounded(P.target_correlations(table(spark, sf_dir, "lineitem"), "l_extendedprice", MEASURES, 2))


@query("SELECT least(greatest(floor((o_totalprice - 0) / 50000.0), 0), 9)::INTEGER AS bin, count(*) AS n FROM orders GROUP BY 1")
def p07_histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0, 10)


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY 1) SELECT o.o_orderpriority, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(min(o_totalprice) FILTER (o_totalprice BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5), 6) AS low, round(max(o_totalprice) FILTER (o_totalprice BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5), 6) AS high, count(*) FILTER (NOT o_totalprice BETWEEN q25 - (q75 - q25) * 1.5 AND q75 + (q75 - q25) * 1.5) AS n_outside FROM orders o JOIN q USING (o_orderpriority) GROUP BY ALL")
def p08_box_statistics(spark, sf_dir):
    return rounded(P.box_statistics(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]))


@query(f"WITH e AS ({HOLES}) SELECT 'event_id' AS \"column\", round(count(event_id) / count(*), 6) AS ratio FROM e UNION ALL SELECT 'value', round(count(value) / count(*), 6) FROM e UNION ALL SELECT 'user_id', round(count(user_id) / count(*), 6) FROM e")
def p09_non_null_ratio(spark, sf_dir):
    return rounded(P.non_null_ratio(holes(spark, sf_dir)))


@query(f"WITH e AS ({HOLES}), r AS (SELECT 'event_id' AS \"column\", count(event_id) AS v, count(*) AS n FROM e UNION ALL SELECT 'value', count(value), count(*) FROM e UNION ALL SELECT 'user_id', count(user_id), count(*) FROM e) SELECT \"column\", v AS n_valid, printf('%.1f%%', v * 100.0 / n) AS valid_ratio, n - v AS n_null FROM r")
def p10_target_analysis(spark, sf_dir):
    return P.target_analysis(holes(spark, sf_dir))


@query(f"WITH e AS ({HOLES}), t AS (SELECT * FROM e WHERE value IS NOT NULL) SELECT 'event_id' AS \"column\", count(event_id) AS n_valid, count(*) AS n, count(event_id) >= 0.5 * count(*) AND count(*) > 0 AS recommended FROM t UNION ALL SELECT 'user_id', count(user_id), count(*), count(user_id) >= 0.5 * count(*) AND count(*) > 0 FROM t")
def p11_feature_validity(spark, sf_dir):
    return P.feature_validity(holes(spark, sf_dir), "value")


@query(f"WITH e AS ({HOLES}) SELECT count(*) * 2 AS n_cells, count(*) * 2 - count(value) - count(event_type) AS n_missing, round((count(*) * 2 - count(value) - count(event_type)) / (count(*) * 2), 6) AS rate, count(*) FILTER (value IS NULL OR event_type IS NULL) AS rows_with_missing, 0 AS columns_over_30_percent FROM e")
def p12_missing_report(spark, sf_dir):
    return rounded(P.missing_report(holes(spark, sf_dir), ["value", "event_type"]))


@query("SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)))::BIGINT AS n_duplicates FROM events")
def p14_duplicates(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "events").select("user_id", "event_type"))


@query("SELECT count(*) AS n_keys, sum(n - 1)::BIGINT AS n_mergeable FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)")
def p15_key_groups(spark, sf_dir):
    return P.key_groups(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query(f"WITH e AS ({HOLES}) SELECT event_type AS value, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 4")
def p16_value_counts(spark, sf_dir):
    return P.value_counts(holes(spark, sf_dir), "event_type", 4)


@query("SELECT count(*) AS n_unique, max(n) AS largest, quantile_cont(n, 0.5)::DOUBLE AS median FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def p16_count_statistics(spark, sf_dir):
    return P.count_statistics(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT 'v' AS \"column\", count(*) FILTER (event_id % 13 = 0) AS n_infinite FROM events")
def p17_infinite_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    return P.infinite_values(e)


@query("WITH f AS (SELECT p_name, regexp_matches(p_name, '^[a-m]') AS ok FROM part ORDER BY p_partkey LIMIT 200) SELECT count(*) AS n_checked, count(*) FILTER (ok) AS n_valid, list_slice(list_sort(list(p_name) FILTER (NOT ok)), 1, 5) AS bad_examples FROM f")
def p18_parse_success(spark, sf_dir):
    return P.parse_success(table(spark, sf_dir, "part"), "p_name", lambda c: c.rlike("^[a-m]"), "p_partkey", 200)
