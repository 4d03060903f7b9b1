"""Queries over string and numeric expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as N
from ..functions import text as X
from .registry import query, rounded, table

#: Part names written in the ways in which mixtures are written.
MIXED = "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', ' ; ') WHEN 1 THEN replace(p_name, ' ', ' + ') WHEN 2 THEN replace(p_name, ' ', '.') ELSE NULL END"
SPLIT = r"list_filter(list_transform(regexp_split_to_array(trim({c}), '\s*[;；|]\s*|\s+\+\s+|\.'), lambda x: trim(x)), lambda x: x <> '')"


def mixed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(MIXED).alias("mix"))


@query(f"SELECT p_partkey, coalesce({SPLIT.format(c='mix')}, []::VARCHAR[]) AS parts FROM (SELECT p_partkey, {MIXED} AS mix FROM part)")
def t01_split(spark, sf_dir):
    return mixed(spark, sf_dir).select("p_partkey", X.split_fragments(F.col("mix")).alias("parts"))


COMPONENTS = SPLIT.replace(r"|\.", "")


@query(f"SELECT p_partkey, coalesce({COMPONENTS.format(c='mix')}, []::VARCHAR[]) AS parts FROM (SELECT p_partkey, {MIXED} AS mix FROM part)")
def t02_split_components(spark, sf_dir):
    return mixed(spark, sf_dir).select("p_partkey", X.split_components(F.col("mix")).alias("parts"))


@query(f"WITH m AS (SELECT p_partkey, list_concat(coalesce({COMPONENTS.format(c='mix')}, []::VARCHAR[]), [p_type]) AS a FROM (SELECT p_partkey, p_type, {MIXED} AS mix FROM part)) SELECT p_partkey, array_to_string(a, '.') AS combined, len(a)::INTEGER AS n FROM m")
def t03_combine(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.expr(MIXED).alias("mix"))
    return p.select("p_partkey", X.combine_components(F.col("mix"), F.col("p_type")).alias("combined"), X.count_components(F.col("mix"), F.col("p_type")).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS clean FROM part")
def t04_clean_raw(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.element_at(F.array(F.lit("N/A"), F.lit(" nan "), F.lit("''"), F.lit("")), (F.col("p_partkey") / 5 % 4 + 1).cast("int"))).otherwise(F.concat(F.lit(" '"), "p_name", F.lit("' ")))
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_raw(raw).alias("clean"))


@query("WITH s AS (SELECT p_partkey, string_split(replace(p_name, ' ', '.'), '.') AS f FROM part) SELECT p_partkey, list_reduce(f, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS repaired FROM s")
def t06_repair(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.repair(F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("repaired"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_name, ' '))), '.') AS key FROM part")
def t07_composition_key(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", X.composition_key(words).alias("key"))


@query(f"WITH m AS (SELECT p_partkey, coalesce({SPLIT.format(c='mix')}, []::VARCHAR[]) AS a FROM (SELECT p_partkey, {MIXED} AS mix FROM part)) SELECT p_partkey, a[1] AS mix_1, a[2] AS mix_2, len(a)::INTEGER AS mix_n_components, nullif(array_to_string(list_sort(list_distinct(a)), '.'), '') AS mix_key FROM m")
def t08_split_columns(spark, sf_dir):
    from ..operators.structures import split_column

    return split_column(mixed(spark, sf_dir), "mix").drop("mix")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, 'nan') || '||' || o_orderpriority AS key, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus || '||' || o_orderpriority END AS strict_key FROM orders")
def t09_formulation_key(spark, sf_dir):
    resin = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.formulation_key(resin, F.col("o_orderpriority")).alias("key"), X.formulation_key(resin, F.col("o_orderpriority"), strict=True).alias("strict_key"))


FIRST = r"try_cast(nullif(regexp_extract({c}, '[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?'), '') AS DOUBLE)"
CONTENT = "CASE p_partkey % 4 WHEN 0 THEN p_size || ' wt%' WHEN 1 THEN '0.' || p_size WHEN 2 THEN '—' ELSE p_brand END"


@query(f"SELECT p_partkey, CASE WHEN c <> '—' THEN {FIRST.format(c='c')} END AS number FROM (SELECT p_partkey, {CONTENT} AS c FROM part)")
def t10_first_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.first_number(F.expr(CONTENT)).alias("number"))


@query(f"SELECT p_partkey, round(CASE WHEN v > 1 THEN v / 100 ELSE v END, 6) AS fraction FROM (SELECT p_partkey, CASE WHEN c <> '—' THEN {FIRST.format(c='c')} END AS v FROM (SELECT p_partkey, {CONTENT} AS c FROM part))")
def t11_fraction(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", X.fraction(F.expr(CONTENT)).alias("fraction")))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 WHEN 3 THEN 0.45 ELSE 0.6 END::DOUBLE AS weight FROM part")
def t12_confidence_weight(spark, sf_dir):
    words = F.array(*map(F.lit, ("High", "mid", "low", "0.45", "7")))
    return table(spark, sf_dir, "part").select("p_partkey", X.confidence_weight(F.get(words, (F.col("p_partkey") % 5).cast("int"))).alias("weight"))


FILLED = "CASE WHEN p_partkey % 3 = 0 THEN 'Nano-Silica ' || p_name WHEN p_partkey % 3 = 1 THEN 'MWCNT' ELSE p_name END"
#: Written out by hand: names inside the text, modulus, density; the first line that fits counts.
FILLER_TABLE = """(VALUES (1, 'silica', 70.0, 2.2), (2, 'sio2', 70, 2.2), (3, 'alumina', 300, 3.95), (4, 'al2o3', 300, 3.95), (5, 'glass', 70, 2.55), (6, 'gf', 70, 2.55),
  (7, 'carbon nanotube', 1000, 1.8), (8, 'cnt', 1000, 1.8), (9, 'graphene', 1000, 2.2), (10, 'go', 1000, 2.2), (11, 'clay', 170, 2.6), (12, 'montmorillonite', 170, 2.6), (13, 'mmt', 170, 2.6),
  (14, 'silver', 83, 10.49), (15, 'ag', 83, 10.49), (16, 'copper', 120, 8.96), (17, 'cu', 120, 8.96), (18, 'aluminum', 69, 2.7), (19, 'al', 69, 2.7), (20, 'boron nitride', 800, 2.1), (21, 'bn', 800, 2.1)) AS f(k, name, modulus, density)"""


@query(f"SELECT p_partkey, coalesce(arg_min(modulus, k), 200)::DOUBLE AS modulus, coalesce(arg_min(density, k), 2.5)::DOUBLE AS density FROM (SELECT p_partkey, lower(trim({FILLED})) AS s FROM part) LEFT JOIN {FILLER_TABLE} ON contains(s, name) GROUP BY 1")
def t13_filler(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.filler_properties(F.expr(FILLED)).alias("f")).select("p_partkey", "f.modulus", "f.density")


@query(r"SELECT c_custkey, left(regexp_replace(regexp_replace(trim(c_name || ' (' || c_mktsegment || ')'), '\s+', '_', 'g'), '[^0-9a-zA-Z_\-一-鿿]+', '_', 'g'), 80) AS name FROM customer")
def t14_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.safe_name(F.format_string("%s (%s)", "c_name", "c_mktsegment")).alias("name"))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace('R' || translate((p_partkey % 100)::VARCHAR, '1234567890', '!$^<>?£¢€§') || 'C' || p_size || 'Cl', '(.)', '\\1 ', 'g')), '\\s+([a-z])', '\\1', 'g') AS tokens FROM part")
def t15_encode_tokens(spark, sf_dir):
    s = F.concat(F.lit("R"), (F.col("p_partkey") % 100).cast("string"), F.lit("C"), F.col("p_size").cast("string"), F.lit("Cl"))
    return table(spark, sf_dir, "part").select("p_partkey", X.encode_tokens(s).alias("tokens"))


@query("SELECT p_partkey, p_partkey::VARCHAR || 'C' AS decoded FROM part")
def t16_decode_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.decode_tokens(F.concat(F.translate(F.col("p_partkey").cast("string"), X.DIGITS, X.DIGIT_SIGNS), F.lit("C"))).alias("decoded"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS text FROM part")
def t17_detokenize(spark, sf_dir):
    words = F.concat(F.array(F.lit("<start>")), F.split("p_name", " "), F.array(F.lit("<end>")))
    return table(spark, sf_dir, "part").select("p_partkey", X.detokenize(words).alias("text"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN r > 0 THEN least(1.0, r, 1 / r) ELSE 1.0 END, 6)::DOUBLE AS alpha_max FROM (SELECT *, l_quantity / 25 - 0.2 AS r FROM lineitem)")
def n02_largest_conversion(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return rounded(l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.largest_conversion(F.col("l_quantity") / 25 - 0.2).alias("alpha_max")))


@query("SELECT p_partkey, round(250 + (450 - 250) * (0.4 * a) / (1 - (1 - 0.4) * a), 6) AS tg FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS a FROM part)")
def n03_glass_transition(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", N.glass_transition(250, 450, 0.4, F.col("p_size") / 50.0).alias("tg")))


@query("SELECT p_partkey, round(3.0 * (1 + 2.0 * eta * v) / (1 - eta * v), 6) AS modulus FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS v, (70.0::DOUBLE / 3 - 1) / (70.0::DOUBLE / 3 + 2 + 1e-12) AS eta FROM part)")
def n04_composite_modulus(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", N.composite_modulus(3, 70, 2, F.col("p_size") / 100.0).alias("modulus")))


@query("SELECT p_partkey, round((w / 2.2) / ((w / 2.2) + (1 - w) / 1.2), 6) AS vf FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS w FROM part)")
def n05_volume_fraction(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", N.volume_fraction(F.col("p_size") / 100.0, 2.2).alias("vf")))


@query("SELECT p_partkey, round(eew, 9) AS eew, round(ahew, 9) AS ahew, round(ahew / eew * 100, 9) AS theoretical_phr, round(100.0 / v, 9) AS actual_phr, round((100.0 / v) / (ahew / eew * 100), 9) AS stoich_ratio, round(100.0 / v - ahew / eew * 100, 9) AS stoich_delta FROM (SELECT p_partkey, p_retailprice / 2 AS eew, 120.0::DOUBLE / 4 AS ahew, p_size::DOUBLE AS v FROM part)")
def n06_stoichiometry(spark, sf_dir):
    s = N.stoichiometry(F.col("p_retailprice"), 2, 120, 4, F.col("p_size").cast("double"), "r/h")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.*"), 9)


@query("SELECT p_partkey, (p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2625.499638 ELSE 627.509474 END::DOUBLE) AS energy FROM part")
def n07_energy(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, ("Hartree", "kJ/mol", "kcal"))), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.energy(F.col("p_retailprice"), unit).alias("energy"))


USERS = "SELECT user_id, avg(value) AS mu, stddev_samp(value) AS sigma FROM events GROUP BY 1"
ERF = "(1 - (1 / (1 + 0.3275911 * abs(x))) * (0.254829592 + (1 / (1 + 0.3275911 * abs(x))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs(x))) * (1.421413741 + (1 / (1 + 0.3275911 * abs(x))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs(x))) * 1.061405429)))) * exp(-x * x)) * sign(x)"


def users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))


@query(f"SELECT user_id, round(mu + 2 * sigma, 6) AS ucb, round(-(mu - 2 * sigma), 6) AS ucb_min, round(sigma, 6) AS uncertainty FROM ({USERS})")
def n09_acquisition_bounds(spark, sf_dir):
    u, mu, s = users(spark, sf_dir), F.col("mu"), F.col("sigma")
    return rounded(u.select("user_id", N.acquisition("ucb", mu, s).alias("ucb"), N.acquisition("ucb", mu, s, maximise=False).alias("ucb_min"), N.acquisition("uncertainty", mu, s).alias("uncertainty")))


@query(f"WITH u AS ({USERS}), g AS (SELECT user_id, sigma, mu - 100 - 0.01 AS gain, (mu - 100 - 0.01) / sigma AS z, (mu - 100 - 0.01) / sigma / sqrt(2) AS x FROM u) SELECT user_id, round(gain * 0.5 * (1 + {ERF}) + sigma * exp(-z * z / 2) / sqrt(2 * pi()), 4) AS ei FROM g")
def n09_expected_improvement(spark, sf_dir):
    return rounded(users(spark, sf_dir).select("user_id", N.acquisition("ei", F.col("mu"), F.col("sigma"), 100.0).alias("ei")), 4)


@query("SELECT n_nationkey, [round(CASE WHEN i % 2 = 0 THEN sin(n_nationkey / pow(10000, 2 * (i // 2) / 8.0)) ELSE cos(n_nationkey / pow(10000, 2 * (i // 2) / 8.0)) END, 6) + 0.0 for i in range(8)] AS code FROM nation")
def n10_positional_encoding(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.transform(N.positional_encoding(F.col("n_nationkey"), 8), lambda x: F.round(x, 6) + 0.0).alias("code"))


@query("SELECT n_nationkey, round(1 / sqrt(512) * least(pow(n_nationkey + 1, -0.5), (n_nationkey + 1) * pow(10, -1.5)), 9) AS rate FROM nation")
def n11_warm_up_rate(spark, sf_dir):
    return rounded(table(spark, sf_dir, "nation").select("n_nationkey", N.warm_up_rate(F.col("n_nationkey") + 1, 512, 10).alias("rate")), 9)
