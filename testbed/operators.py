"""Single operators run over the given tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import (
    absent_as_zero,
    alnum_piece,
    choose,
    contains,
    half_even,
    not_in_nor_null,
    number_text,
    ordinal,
    patch,
    recode_first,
    recode_last,
    safe_div,
    split_decile,
    split_last,
    strict_avg,
    strict_sum,
    sum0,
)
from scenlens.operators import (
    annual_series,
    broadcast_if_small,
    compare,
    cross_with,
    decile_gini,
    decile_shares,
    fit_line,
    fixed_class,
    gap_to_target,
    inline_table,
    kmeans_class,
    lookup,
    palma,
    pivot_cells,
    pivot_sums,
    pretty_class,
    share_of_group,
    split_equally,
    spread,
    strict_lookup,
    to_long,
    union_all,
    with_group_total,
)
from scenlens.plans.emissions import co2_equivalent, gas_group, value_span
from scenlens.plans.energy import display_region, percent_label
from scenlens.plans.prices import deflator
from scenlens.scenarios import POLICY
from scenlens.sinks import chart_table, map_table, report_table, write_report, write_table
from scenlens.sources import (
    Project,
    policy_caps,
    policy_targets,
    read_csv,
    read_csv_after,
    read_sheets,
    read_wide_years,
    shared_folder,
)
from testbed.entry import Entry, canon, fresh, kmeans, long, number_text as number_sql, pretty, wide

RAW = {"N": "RegGHGPol_Ineq", "A": "RegGHGPol_Gini25_Ineq", "R": "RegGHGPol_Gini50_Ineq"}
RAW_SQL = "CASE l_returnflag WHEN 'N' THEN 'RegGHGPol_Ineq' WHEN 'A' THEN 'RegGHGPol_Gini25_Ineq' ELSE 'RegGHGPol_Gini50_Ineq' END"
NAME_SQL = "CASE l_returnflag WHEN 'N' THEN 'Baseline' WHEN 'A' THEN 'Gini25' ELSE 'Gini50' END"
SHIP_YEAR = "CAST(year(l_shipdate) AS INT)"
ORDER_YEAR = "CAST(year(o_orderdate) AS INT)"


def lines(t) -> DataFrame:
    """Line items with a raw scenario label and the shipping year."""
    df = t.base("lineitem")
    raw = F.when(F.col("l_returnflag") == "N", RAW["N"]).when(F.col("l_returnflag") == "A", RAW["A"]).otherwise(RAW["R"])
    return df.withColumn("scenario", raw).withColumn("year", F.year("l_shipdate"))


def orders(t) -> DataFrame:
    return t.base("orders").withColumn("year", F.year("o_orderdate")).withColumn(
        "value", F.floor("o_totalprice").cast("double")
    )


ORDERS_SQL = f"SELECT *, {ORDER_YEAR} AS year, floor(o_totalprice) AS value FROM orders"
NATIONS_SQL = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"


def nations(t) -> DataFrame:
    regions = t.base("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return strict_lookup(t.base("nation"), regions, ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


def sector_rows(t) -> DataFrame:
    """Quantities by part type, after the first year; the date bound reaches the scan."""
    parts = t.base("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("sector"))
    return (
        lines(t).where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        .join(parts, "l_partkey")
        .select("scenario", "year", "sector", F.lit("unit").alias("Units"), F.col("l_quantity").alias("value"))
    )


SECTOR_SQL = f"""SELECT {NAME_SQL} AS scenario, {SHIP_YEAR} AS year, p_type AS sector, 'unit' AS "Units", l_quantity AS value
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1996-01-01'"""


def region_customers(t) -> DataFrame:
    """Customers per nation with the nation's region."""
    counted = t.base("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).cast("double").alias("pop")
    )
    return strict_lookup(counted, nations(t), ["n_nationkey"], unique=True)


def customer_rows(t) -> DataFrame:
    """Orders with the market segment and a decile taken from the customer key."""
    who = t.base("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return orders(t).join(who, "o_custkey").select(
        "year", F.col("c_mktsegment").alias("segment"), "c_nationkey",
        F.concat(F.lit("d"), F.col("o_custkey") % 10 + 1).alias("decile"), "value",
    )


CUSTOMER_SQL = f"""SELECT {ORDER_YEAR} AS year, c_mktsegment AS segment, c_nationkey,
    'd' || (o_custkey % 10 + 1) AS decile, floor(o_totalprice) AS value FROM orders JOIN customer ON c_custkey = o_custkey"""

OPS: dict[str, Entry] = {}


def add(name: str, run, sql: str | None, digits: dict[str, int] | None = None) -> None:
    OPS[name] = Entry(run, sql, digits or {})


# ---- recodes and comparisons ---------------------------------------------------

add("q_scenario_recode",
    lambda t: lines(t).groupBy("scenario").agg(strict_sum("l_quantity").alias("value"), F.count(F.lit(1)).alias("n"))
    .groupBy(POLICY.canonical().alias("scenario")).agg(strict_sum("value").alias("value"), F.sum("n").alias("n")),
    f"SELECT {canon(column='s')} AS scenario, sum(l_quantity) AS value, count(*) AS n FROM (SELECT {RAW_SQL} AS s, l_quantity FROM lineitem) AS x GROUP BY 1")
add("q_diff_baseline",
    lambda t: compare(sector_rows(t), ["year", "sector", "Units"], POLICY),
    f'WITH r AS ({SECTOR_SQL}), w AS ({wide("r", "year, sector, Units")}) {long("w", "year, sector, Units")}')
add("q_rel_change_label",
    lambda t: compare(lines(t), ["year"], POLICY, "percent", value="l_quantity", out="annual_change").withColumn(
        "label", percent_label("annual_change")),
    f"""WITH r AS (SELECT {NAME_SQL} AS scenario, {SHIP_YEAR} AS year, l_quantity AS value FROM lineitem), w AS ({wide("r", "year")})
    SELECT *, {number_sql('annual_change', 1)} || ' %' AS label FROM ({long("w", "year", "percent", "annual_change")}) AS x""")
add("q_fraction_change",
    lambda t: compare(lines(t), ["year", "l_linenumber"], POLICY, "fraction", value="l_quantity"),
    f"""WITH r AS (SELECT {NAME_SQL} AS scenario, {SHIP_YEAR} AS year, l_linenumber, l_quantity AS value FROM lineitem),
    w AS ({wide("r", "year, l_linenumber")}) {long("w", "year, l_linenumber", "fraction")}""")
add("q_ratio_change",
    lambda t: compare(lines(t), ["year", "l_linenumber"], POLICY, "ratio", value="l_quantity"),
    f"""WITH r AS (SELECT {NAME_SQL} AS scenario, {SHIP_YEAR} AS year, l_linenumber, l_quantity AS value FROM lineitem),
    w AS ({wide("r", "year, l_linenumber")}) {long("w", "year, l_linenumber", "ratio")}""")
add("q_year_ratio",
    lambda t: pivot_sums(lines(t), ["scenario", "l_suppkey"], "year", {"y1996": 1996, "y2000": 2000}, "l_quantity").withColumn(
        "change", safe_div("y2000", "y1996")),
    f"""SELECT *, y2000 / nullif(y1996, 0) AS change FROM (SELECT {RAW_SQL} AS scenario, l_suppkey,
    sum(l_quantity) FILTER (WHERE year(l_shipdate) = 1996) AS y1996, sum(l_quantity) FILTER (WHERE year(l_shipdate) = 2000) AS y2000
    FROM lineitem GROUP BY 1, l_suppkey) AS x""")
add("q_gap_to_target",
    lambda t: gap_to_target(
        spread(lines(t), ["year"], POLICY, "l_quantity").withColumn("target", F.col("Baseline") + 100), "target",
        {"Base": "Baseline", "Gini25": "Gini25", "Gini50": "Gini50"}, ["year"], "gap"),
    f"""WITH r AS (SELECT {NAME_SQL} AS scenario, {SHIP_YEAR} AS year, l_quantity AS value FROM lineitem), w AS ({wide("r", "year")})
    SELECT year, 'Base' AS scenario, b + 100 - b AS gap FROM w UNION ALL SELECT year, 'Gini25', b + 100 - g25 FROM w
    UNION ALL SELECT year, 'Gini50', b + 100 - g50 FROM w""")
add("q_sector_rules_last",
    lambda t: t.base("part").groupBy(recode_last("p_name", [
        ("has", "ring", "Ring"), ("has", "small", "Small"), ("has", "red", "Red")]).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN contains(p_name, 'red') THEN 'Red' WHEN contains(p_name, 'small') THEN 'Small'
    WHEN contains(p_name, 'ring') THEN 'Ring' ELSE p_name END AS kind, count(*) AS n FROM part GROUP BY 1""")
add("q_pattern_replace",
    lambda t: t.base("part").select(
        "p_partkey", F.regexp_replace("p_brand", "Brand#", "B").alias("brand"),
        F.regexp_replace(F.concat(F.lit("diff_"), F.lower("p_type"), F.lit("_perc")), "diff_|_perc", "").alias("kind"),
        F.upper("p_name").alias("name")),
    """SELECT p_partkey, replace(p_brand, 'Brand#', 'B') AS brand, lower(p_type) AS kind, upper(p_name) AS name FROM part""")
add("q_display_region",
    lambda t: t.base("nation").select(display_region(F.concat("n_name", F.lit("_Trade"))).alias("a"), display_region("n_name").alias("b")),
    "SELECT 'EFTA' AS a, replace(n_name, '_', ' ') AS b FROM nation")
add("q_gas_group",
    lambda t: t.base("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ghg", recode_first("event_type", [
            ("is", "click", "CO2"), ("is", "view", "CO2LUC"), ("is", "purchase", "CH4_AGR"), ("is", "error", "N2O")])
    ).groupBy(gas_group().alias("group"), gas_group("ghg", True).alias("group_n2o")).agg(F.sum("n").alias("n")),
    """SELECT CASE event_type WHEN 'click' THEN 'CO2' WHEN 'view' THEN 'CO2_LUC' WHEN 'purchase' THEN 'CH4' ELSE 'F-gases' END AS "group",
    CASE event_type WHEN 'click' THEN 'CO2' WHEN 'view' THEN 'CO2_LUC' WHEN 'purchase' THEN 'CH4' WHEN 'error' THEN 'N2O' ELSE 'F-gases' END AS group_n2o,
    count(*) AS n FROM events GROUP BY 1, 2""")
add("q_patch_clamp",
    lambda t: t.base("customer").select(
        "c_custkey", patch(choose(F.col("c_acctbal") < 0, 0.01, F.col("c_acctbal")), [
            ({"c_mktsegment": "BUILDING", "c_nationkey": 3}, 0), ({"c_nationkey": 7}, 5)]).alias("value")),
    """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 5e0 WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN 0e0
    WHEN c_acctbal < 0 THEN 0.01e0 ELSE c_acctbal END AS value FROM customer""")
add("q_ordinal_levels",
    lambda t: t.base("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "level", ordinal("o_orderpriority", ("5-LOW", "3-MEDIUM", "2-HIGH"))).orderBy(F.col("level").asc_nulls_last()),
    """SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 END AS level
    FROM orders GROUP BY o_orderpriority ORDER BY level NULLS LAST""")
add("q_sorted_nulls_last",
    lambda t: t.base("customer").select(
        "c_mktsegment", F.nullif("c_nationkey", F.lit(3)).alias("nation"), "c_custkey").orderBy(
        F.col("c_mktsegment").asc_nulls_last(), F.col("nation").asc_nulls_last(), F.col("c_custkey").desc()),
    """SELECT c_mktsegment, nullif(c_nationkey, 3) AS nation, c_custkey FROM customer
    ORDER BY c_mktsegment NULLS LAST, nation NULLS LAST, c_custkey DESC""")

# ---- aggregates with gaps --------------------------------------------------------

GAP = "nullif(l_quantity, 1)"


def gap():
    return F.nullif(F.col("l_quantity"), F.lit(1.0))


add("q_strict_sum_nulls",
    lambda t: t.base("lineitem").withColumn("v", gap()).groupBy("l_orderkey").agg(strict_sum("v").alias("value")),
    f"SELECT l_orderkey, CASE WHEN count(*) = count({GAP}) THEN sum({GAP}) END AS value FROM lineitem GROUP BY l_orderkey")
add("q_sum0_nulls",
    lambda t: t.base("lineitem").withColumn("v", gap()).groupBy("l_orderkey", "l_linenumber").agg(sum0("v").alias("value")),
    f"SELECT l_orderkey, l_linenumber, coalesce(sum({GAP}), 0) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber")
add("q_group_mean",
    lambda t: t.base("customer").groupBy("c_nationkey").agg(
        strict_avg(F.floor("c_acctbal")).alias("mean"), strict_avg(F.nullif(F.floor("c_acctbal"), F.lit(1))).alias("gap_mean")),
    """SELECT c_nationkey, avg(floor(c_acctbal)) AS mean, CASE WHEN count(*) = count(nullif(floor(c_acctbal), 1)) THEN
    avg(nullif(floor(c_acctbal), 1)) END AS gap_mean FROM customer GROUP BY c_nationkey""", {"mean": 6, "gap_mean": 6})
add("q_minmax_global",
    lambda t: value_span(t.base("orders"), "o_totalprice"),
    "SELECT min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders")
add("q_group_ols",
    lambda t: fit_line(lines(t), ["scenario", "year"], "l_extendedprice", "l_quantity"),
    f"""SELECT {RAW_SQL} AS scenario, {SHIP_YEAR} AS year, regr_slope(l_extendedprice, l_quantity) AS slope,
    regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
    CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""", {"slope": 4, "intercept": 4, "r2": 6})
add("q_distinct_regions",
    lambda t: nations(t).join(t.base("customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    .select("r_name", "n_name").distinct(),
    f"SELECT DISTINCT r_name, n_name FROM ({NATIONS_SQL}) AS x JOIN customer ON c_nationkey = n_nationkey")
add("q_distinct_count",
    lambda t: t.base("orders").groupBy("o_orderstatus").agg(
        F.count_distinct("o_orderpriority").alias("priorities")).withColumn("part", F.lit(1.0) / F.col("priorities")),
    "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS priorities, 1e0 / count(DISTINCT o_orderpriority) AS part FROM orders GROUP BY o_orderstatus")


def grains(t) -> DataFrame:
    """Totals by nation, region and world, stacked."""
    by_nation = strict_lookup(
        customer_rows(t).groupBy(F.col("c_nationkey").alias("n_nationkey"), "year").agg(strict_sum("value").alias("value")),
        nations(t), ["n_nationkey"], unique=True)
    return union_all(*[
        by_nation.groupBy(*keys).agg(strict_sum("value").alias("value"))
        for keys in (["n_name", "r_name", "year"], ["r_name", "year"], ["year"])
    ])


add("q_grain_rollup", grains,
    f"""WITH x AS (SELECT c.*, n_name, r_name FROM ({CUSTOMER_SQL}) AS c JOIN ({NATIONS_SQL}) AS n ON n_nationkey = c_nationkey)
    SELECT n_name, r_name, year, sum(value) AS value FROM x GROUP BY n_name, r_name, year UNION ALL
    SELECT NULL, r_name, year, sum(value) FROM x GROUP BY r_name, year UNION ALL SELECT NULL, NULL, year, sum(value) FROM x GROUP BY year""")

# ---- inequality --------------------------------------------------------------------

add("q_palma", lambda t: palma(customer_rows(t), ["segment", "year"]),
    f"""SELECT segment, year, d10 / nullif(d1 + d2 + d3 + d4, 0) AS palma FROM (SELECT segment, year,
    {", ".join(f"sum(value) FILTER (WHERE decile = '{d}') AS {d}" for d in ("d1", "d2", "d3", "d4", "d10"))}
    FROM ({CUSTOMER_SQL}) AS x GROUP BY segment, year) AS y""")
add("q_decile_gini", lambda t: decile_gini(customer_rows(t), ["segment", "year"]),
    f"""WITH d AS (SELECT segment, year, decile, sum(value) AS v FROM ({CUSTOMER_SQL}) AS x GROUP BY ALL),
    s AS (SELECT *, v / sum(v) OVER (PARTITION BY segment, year) AS share FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY segment, year ORDER BY share) AS i, count(*) OVER (PARTITION BY segment, year) AS n FROM s)
    SELECT segment, year, 1 - sum(share * (1 + 2 * (n - i))) / any_value(n) AS gini FROM r GROUP BY segment, year""", {"gini": 10})
add("q_decile_shares", lambda t: decile_shares(customer_rows(t), ["segment", "year"]),
    f"""WITH d AS (SELECT segment, year, decile AS category, sum(value) AS v FROM ({CUSTOMER_SQL}) AS x GROUP BY ALL),
    s AS (SELECT segment, year, category, v / sum(v) OVER (PARTITION BY segment, year) AS share FROM d)
    SELECT *, sum(share) OVER (PARTITION BY segment, year) AS share_check FROM s""", {"share_check": 8})
add("q_share_of_group",
    lambda t: share_of_group(lines(t).select("l_orderkey", "l_linenumber", "l_suppkey", "year", "l_quantity"), ["l_suppkey", "year"], "l_quantity"),
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, {SHIP_YEAR} AS year, l_quantity,
    l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_suppkey, year(l_shipdate)), 0) AS share FROM lineitem""")
add("q_equal_split_population",
    lambda t: split_equally(
        region_customers(t).withColumn("pop", F.col("pop") * C.THOUSAND_PERSONS),
        customer_rows(t).select("decile"), "pop").select("n_name", "decile", "pop"),
    f"""SELECT n_name, decile, p * 1 / (SELECT count(DISTINCT decile) FROM ({CUSTOMER_SQL}) AS a) AS pop
    FROM (SELECT n_name, count(*) * 1e3 AS p FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) AS x,
    (SELECT DISTINCT decile FROM ({CUSTOMER_SQL}) AS b) AS d""")


def decile_text_rows(t) -> DataFrame:
    who = strict_lookup(
        t.base("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), nations(t), ["n_nationkey"], unique=True
    ).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    rows = orders(t).withColumn(
        "sector_decile", F.concat(F.lit("resid_"), F.lower("o_orderstatus"), F.lit("_d"), F.col("o_custkey") % 10 + 1))
    stem, decile = split_decile("sector_decile")
    return rows.join(who, "o_custkey").select("year", "r_name", stem.alias("sector"), decile.alias("decile"), "value")


add("q_per_capita_decile",
    lambda t: strict_lookup(
        decile_text_rows(t).groupBy("r_name", "year", "sector", "decile").agg(strict_sum("value").alias("value")),
        region_customers(t).groupBy("r_name").agg(strict_sum("pop").alias("pop")), ["r_name"], unique=True,
    ).withColumn("value_pc", safe_div(F.col("value") * C.EJ_TO_GJ, "pop")).withColumn(
        "value_pc_decile", safe_div(F.col("value") * C.EJ_TO_GJ, F.col("pop") * 0.1)),
    f"""WITH p AS (SELECT r_name, count(*) * 1e0 AS pop FROM customer JOIN ({NATIONS_SQL}) AS n ON n_nationkey = c_nationkey GROUP BY r_name),
    v AS (SELECT r_name, {ORDER_YEAR} AS year, 'resid_' || lower(o_orderstatus) AS sector, 'd' || (o_custkey % 10 + 1) AS decile,
    sum(floor(o_totalprice)) AS value FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN ({NATIONS_SQL}) AS n ON n_nationkey = c_nationkey GROUP BY 1, 2, 3, 4)
    SELECT v.*, pop, value * 1e9 / pop AS value_pc, value * 1e9 / (pop * 0.1e0) AS value_pc_decile FROM v JOIN p USING (r_name)""")

# ---- roll-ups ----------------------------------------------------------------------

add("q_region_rollup_strict",
    lambda t: strict_lookup(
        customer_rows(t).groupBy(F.col("c_nationkey").alias("n_nationkey"), "year").agg(strict_sum("value").alias("value")),
        nations(t), ["n_nationkey"], unique=True,
    ).groupBy("r_name", "year").agg(strict_sum("value").alias("value")),
    f"""SELECT r_name, year, sum(value) AS value FROM ({CUSTOMER_SQL}) AS c JOIN ({NATIONS_SQL}) AS n ON n_nationkey = c_nationkey
    GROUP BY r_name, year""")


def weighted(t) -> DataFrame:
    """Nation weights in their region times the segment shares of the nation."""
    weights = with_group_total(region_customers(t), ["r_name"], "pop", "region_pop").withColumn(
        "weight", safe_div("pop", "region_pop"))
    groups = t.base("customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(
        F.count(F.lit(1)).cast("double").alias("members"))
    return strict_lookup(groups, weights, ["n_nationkey"], unique=True).withColumn(
        "demo_share", safe_div("members", "pop"))


add("q_weighted_rollup",
    lambda t: weighted(t).groupBy("r_name", "c_mktsegment").agg(
        strict_sum(F.col("demo_share") * F.col("weight") * F.col("region_pop")).alias("pop_group")),
    f"""WITH m AS (SELECT c_nationkey, c_mktsegment, count(*) * 1e0 AS members FROM customer GROUP BY ALL),
    p AS (SELECT *, sum(pop) OVER (PARTITION BY r_name) AS region_pop FROM (SELECT c_nationkey, r_name, count(*) * 1e0 AS pop
    FROM customer JOIN ({NATIONS_SQL}) AS n ON n_nationkey = c_nationkey GROUP BY ALL) AS x)
    SELECT r_name, c_mktsegment, sum(members / pop * (pop / region_pop) * region_pop) AS pop_group FROM m JOIN p USING (c_nationkey)
    GROUP BY r_name, c_mktsegment""", {"pop_group": 6})
add("q_adequacy_index",
    lambda t: strict_lookup(
        strict_lookup(customer_rows(t).groupBy("segment", "year").agg(strict_sum("value").alias("value")),
                      t.base("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
                          F.count(F.lit(1)).cast("double").alias("pop")), ["segment"], unique=True),
        lines(t).groupBy("year").agg(strict_sum("l_quantity").alias("need")), ["year"], unique=True,
    ).select("segment", "year", (safe_div("value", "need") * F.col("pop") * 100).alias("index")),
    f"""SELECT segment, year, value / nullif(need, 0) * pop * 100 AS "index"
    FROM (SELECT segment, year, sum(value) AS value FROM ({CUSTOMER_SQL}) AS a GROUP BY ALL) AS v
    JOIN (SELECT c_mktsegment AS segment, count(*) * 1e0 AS pop FROM customer GROUP BY ALL) AS p USING (segment)
    JOIN (SELECT {SHIP_YEAR} AS year, sum(l_quantity) AS need FROM lineitem GROUP BY 1) AS n USING (year)""")


def odd_years(t) -> DataFrame:
    """Totals by priority and year, the even years without a value."""
    known = F.when(F.col("year") % 2 == 1, F.col("value"))
    return orders(t).groupBy("o_orderpriority", "year").agg(strict_sum(known).alias("value"))


add("q_densify_interpolate",
    lambda t: annual_series(odd_years(t), ["o_orderpriority"], 1995, 2003),
    f"""WITH k AS (SELECT o_orderpriority, {ORDER_YEAR} AS year, sum(floor(o_totalprice)) AS value FROM orders
    WHERE year(o_orderdate) % 2 = 1 GROUP BY 1, 2),
    g AS (SELECT o_orderpriority, CAST(year AS INT) AS year FROM (SELECT DISTINCT o_orderpriority FROM k) AS a, (SELECT unnest(generate_series(1995, 2003)) AS year) AS b)
    SELECT g.o_orderpriority, g.year, CASE WHEN a.year = b.year THEN a.value
    ELSE a.value + (b.value - a.value) * (g.year - a.year) / (b.year - a.year) END AS value
    FROM g LEFT JOIN k a ON a.o_orderpriority = g.o_orderpriority AND a.year = (SELECT max(year) FROM k WHERE k.o_orderpriority = g.o_orderpriority AND k.year <= g.year)
    LEFT JOIN k b ON b.o_orderpriority = g.o_orderpriority AND b.year = (SELECT min(year) FROM k WHERE k.o_orderpriority = g.o_orderpriority AND k.year >= g.year)""")
add("q_cumulative_interpolated",
    lambda t: annual_series(odd_years(t), ["o_orderpriority"], 1995, 2001).groupBy("o_orderpriority").agg(
        strict_sum("value").alias("total")),
    f"""WITH k AS (SELECT o_orderpriority, {ORDER_YEAR} AS year, sum(floor(o_totalprice)) AS value FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1, 2),
    n AS (SELECT *, lead(value) OVER (PARTITION BY o_orderpriority ORDER BY year) AS nxt FROM k)
    SELECT o_orderpriority, sum(value + coalesce(value + (nxt - value) * 1 / 2, 0)) AS total FROM n GROUP BY o_orderpriority""")
GAS_RULES = [("is", "click", "CH4"), ("is", "view", "N2O"), ("is", "purchase", "HFC125"), ("is", "signup", "CO2LUC")]
add("q_gwp_total",
    lambda t: co2_equivalent(
        union_all(
            t.base("events").select(
                recode_first("event_type", GAS_RULES).alias("ghg"), F.dayofmonth("ts").alias("day"), F.floor("value").cast("double").alias("value")),
            t.base("events").select(F.lit("CO2").alias("ghg"), F.dayofmonth("ts").alias("day"), F.lit(1.0).alias("value"))),
        inline_table(t.spark, C.GWP, "ghg string, gwp double"), ["day"]),
    """SELECT CAST(day(ts) AS INT) AS day, 'MtCO2e' AS "Units", sum(floor(value) * CASE event_type WHEN 'click' THEN 28 WHEN 'view' THEN 265
    WHEN 'purchase' THEN 3.17e0 WHEN 'signup' THEN 3.666666667e0 ELSE 0 END) + count(*) * 3.666666667e0 AS value FROM events GROUP BY 1""",
    {"value": 4})


def yearly(t) -> DataFrame:
    return lines(t).groupBy("scenario", "year", "l_linenumber").agg(strict_sum("l_quantity").alias("value"))


def misses(t) -> DataFrame:
    wide_rows = spread(yearly(t), ["year", "l_linenumber"], POLICY, cells="single")
    target = lines(t).groupBy("year", "l_linenumber").agg((strict_sum("l_quantity") / 3).alias("target"))
    gaps = gap_to_target(
        strict_lookup(wide_rows, target, ["year", "l_linenumber"], unique=True), "target",
        {s: s for s in POLICY.names}, ["year", "l_linenumber", "target"], "gap")
    rounded = half_even("gap", 2)
    return gaps.where((F.col("gap") < 0) & (F.col("target") > 0)).withColumn(
        "perc", half_even(safe_div(rounded, "target"), 2)).where(F.abs("perc") > 0.02).withColumn("gap", rounded)


add("q_compliance", misses,
    f"""WITH s AS (SELECT {NAME_SQL} AS scenario, {SHIP_YEAR} AS year, l_linenumber, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3),
    t AS (SELECT year, l_linenumber, sum(value) / 3 AS target FROM s GROUP BY year, l_linenumber),
    g AS (SELECT year, l_linenumber, target, scenario, target - value AS gap FROM s JOIN t USING (year, l_linenumber))
    SELECT year, l_linenumber, target, scenario, round_even(gap, 2) AS gap, round_even(round_even(gap, 2) / target, 2) AS perc
    FROM g WHERE gap < 0 AND target > 0 AND abs(round_even(round_even(gap, 2) / target, 2)) > 0.02e0""", {"target": 6})

# ---- filters -------------------------------------------------------------------------

add("q_not_grepl",
    lambda t: t.base("part").withColumn("kind", F.nullif("p_type", F.lit("PROMO"))).where(~contains("kind", "ECON|SMALL")).select("p_partkey", "kind"),
    """SELECT p_partkey, nullif(p_type, 'PROMO') AS kind FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')""")
add("q_not_in_null",
    lambda t: t.base("part").withColumn("kind", F.nullif("p_type", F.lit("PROMO"))).where(not_in_nor_null("kind", ("ECONOMY", "SMALL"))).select("p_partkey", "kind"),
    "SELECT p_partkey, p_type AS kind FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO')")
add("q_pattern_or",
    lambda t: t.base("part").where(contains("p_name", "ring") | contains("p_name", "bolt")).select("p_partkey", "p_name"),
    "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')")
add("q_range_filter",
    lambda t: t.base("orders").where(
        (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
        & F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey", "o_totalprice"),
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
    AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW'""")
add("q_abs_threshold",
    lambda t: t.base("customer").where((F.abs("c_acctbal") > 900) & (F.col("c_acctbal") < 0)).select("c_custkey", "c_acctbal"),
    "SELECT c_custkey, c_acctbal FROM customer WHERE abs(c_acctbal) > 900 AND c_acctbal < 0")
add("q_complete_cases",
    lambda t: t.base("orders").select("o_orderkey", "o_orderstatus").join(
        t.base("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", gap().alias("v")), "o_orderkey", "left").na.drop("any"),
    """SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity <> 1""")
add("q_semi_year",
    lambda t: orders(t).groupBy("year").agg(strict_sum("value").alias("value")).join(
        lines(t).where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("year").distinct(), "year", "left_semi"),
    f"""SELECT year, sum(value) AS value FROM ({ORDERS_SQL}) AS o WHERE EXISTS
    (SELECT 1 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND year(l_shipdate) = o.year) GROUP BY year""")

# ---- joins ---------------------------------------------------------------------------

add("q_alias_join",
    lambda t: lookup(
        t.base("nation"), inline_table(t.spark, [("NATION_1", "First"), ("NATION_2", "Second")], "n_name string, alias string"), ["n_name"]
    ).select("n_nationkey", F.translate(F.coalesce("alias", "n_name"), "_", " ").alias("region")),
    """SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'First' WHEN 'NATION_2' THEN 'Second' ELSE replace(n_name, '_', ' ') END AS region FROM nation""")
add("q_food_group_join",
    lambda t: lookup(
        t.base("part"), inline_table(t.spark, [("ECONOMY", "Basic"), ("SMALL", "Basic"), ("LARGE", "Big")], "p_type string, grp string"), ["p_type"]
    ).groupBy("grp").agg(strict_sum("p_size").alias("size"), F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Basic' WHEN p_type = 'LARGE' THEN 'Big' END AS grp,
    CAST(sum(p_size) AS BIGINT) AS size, count(*) AS n FROM part GROUP BY 1""")
add("q_multi_key_join",
    lambda t: t.base("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers")).join(
        customer_rows(t).groupBy("c_nationkey", F.col("segment").alias("c_mktsegment")).agg(strict_sum("value").alias("value")),
        ["c_nationkey", "c_mktsegment"], "left"),
    f"""SELECT * FROM (SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM customer GROUP BY ALL) AS a LEFT JOIN
    (SELECT c_nationkey, segment AS c_mktsegment, sum(value) AS value FROM ({CUSTOMER_SQL}) AS x GROUP BY ALL) AS b USING (c_nationkey, c_mktsegment)""")
add("q_null_safe_lookup",
    lambda t: strict_lookup(
        t.base("lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("k")),
        broadcast_if_small(t.base("lineitem").groupBy(F.nullif("l_linenumber", F.lit(7)).alias("k")).agg(F.sum("l_quantity").alias("total"))),
        ["k"], unique=True),
    """SELECT l_orderkey, nullif(l_linenumber, 7) AS k, total FROM lineitem
    JOIN (SELECT l_linenumber AS n, sum(l_quantity) AS total FROM lineitem GROUP BY n) AS s ON n = l_linenumber""")
add("q_declared_fan_out",
    lambda t: region_customers(t).select("r_name", "n_name", "pop").join(
        customer_rows(t).join(t.base("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
        .join(t.base("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
        .groupBy("r_name", "decile").agg(strict_sum("value").alias("value")), "r_name", "left"),
    f"""WITH n AS ({NATIONS_SQL}) SELECT r_name, n_name, pop, decile, value FROM
    (SELECT r_name, n_name, count(*) * 1e0 AS pop FROM customer JOIN n ON n_nationkey = c_nationkey GROUP BY ALL) AS a LEFT JOIN
    (SELECT r_name, decile, sum(value) AS value FROM ({CUSTOMER_SQL}) AS c JOIN n ON n_nationkey = c_nationkey GROUP BY ALL) AS b USING (r_name)""")
add("q_cross_repeat",
    lambda t: cross_with(t.base("supplier").select("s_suppkey", "s_nationkey"), scenario=POLICY.names, year=(2030, 2050)),
    """SELECT s_suppkey, s_nationkey, scenario, year FROM supplier, (SELECT unnest(['Baseline', 'Gini25', 'Gini50']) AS scenario) AS a,
    (SELECT unnest([2030, 2050]) AS year) AS b""")
add("q_union_missing_cols",
    lambda t: union_all(
        t.base("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t.base("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))),
    """SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL BY NAME SELECT s_acctbal AS balance, s_nationkey AS nation FROM supplier""")

# ---- text and numbers --------------------------------------------------------------------

add("q_split_alnum",
    lambda t: t.base("orders").select(
        "o_orderkey", alnum_piece("o_orderpriority", 1).alias("rank"), alnum_piece("o_orderpriority", 2).alias("word"),
        alnum_piece("o_orderpriority", 3).alias("rest")),
    """SELECT o_orderkey, p[1] AS rank, p[2] AS word, p[3] AS rest FROM (SELECT o_orderkey, regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+') AS p FROM orders) AS x""")


def last_split(t) -> DataFrame:
    label = F.when(F.col("p_size") % 3 == 0, F.translate("p_name", " ", "_")).when(
        F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("_a_d"), F.col("p_size"))).otherwise(F.col("p_type"))
    left, right = split_last(label)
    stem, decile = split_decile(label)
    return t.base("part").select("p_partkey", left.alias("a"), right.alias("b"), stem.alias("stem"), decile.alias("decile"))


add("q_split_last", last_split,
    """WITH l AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_type || '_a_d' || p_size ELSE p_type END AS x FROM part)
    SELECT p_partkey, CASE WHEN contains(x, '_') THEN regexp_extract(x, '^(.*)_([^_]*)$', 1) ELSE x END AS a,
    CASE WHEN contains(x, '_') THEN regexp_extract(x, '^(.*)_([^_]*)$', 2) END AS b, regexp_replace(x, '_d[0-9]+$', '') AS stem,
    CASE WHEN regexp_matches(x, '_d[0-9]+$') THEN regexp_extract(x, '_(d[0-9]+)$', 1) END AS decile FROM l""")
add("q_number_text",
    lambda t: t.base("customer").select(
        "c_custkey", number_text(F.col("c_acctbal") / 1000, 1).alias("a"), number_text("c_acctbal", 0).alias("b"),
        number_text(F.col("c_nationkey").cast("double"), 2).alias("c")),
    f"""SELECT c_custkey, {number_sql('c_acctbal / 1000', 1)} AS a, {number_sql('c_acctbal', 0)} AS b,
    {number_sql('CAST(c_nationkey AS DOUBLE)', 2)} AS c FROM customer""")
add("q_half_even",
    lambda t: t.base("lineitem").select("l_orderkey", half_even(F.col("l_quantity") / 2).alias("a"), half_even(F.col("l_quantity") / 8, 2).alias("b")),
    "SELECT l_orderkey, round_even(l_quantity / 2, 0) AS a, round_even(l_quantity / 8, 2) AS b FROM lineitem")
add("q_choose_missing",
    lambda t: t.base("customer").select(
        "c_custkey", choose(F.nullif("c_nationkey", F.lit(4)) > 10, "high", "low").alias("a"),
        F.when(F.nullif("c_nationkey", F.lit(4)) > 10, "high").otherwise("low").alias("b")),
    """SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN NULL WHEN c_nationkey > 10 THEN 'high' ELSE 'low' END AS a,
    CASE WHEN c_nationkey > 10 THEN 'high' ELSE 'low' END AS b FROM customer""")
add("q_sentinel_cast",
    lambda t: sentinel_round_trip(t),
    "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part")
add("q_replace_na",
    lambda t: t.base("orders").select("o_orderkey").join(
        t.base("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(strict_sum("l_quantity").alias("q")), "o_orderkey", "left"
    ).select("o_orderkey", absent_as_zero("q").alias("diff")),
    "SELECT o_orderkey, coalesce(sum(l_quantity), 0) AS diff FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
add("q_sequential_columns",
    lambda t: t.base("orders").select("o_orderkey", F.col("o_totalprice").alias("v")).withColumn("v", F.floor("v") / 100).withColumn(
        "share", F.col("v") / 7).withColumn("share", half_even("share", 2)),
    "SELECT o_orderkey, floor(o_totalprice) / 100 AS v, round_even(floor(o_totalprice) / 100 / 7, 2) AS share FROM orders")
add("q_select_by_name",
    lambda t: (lambda df: df.select("o_orderkey", *[c for c in df.columns if c.lower().startswith("o_order") and "status" not in c and c != "o_orderkey"]))(t.base("orders")),
    "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders")
add("q_deflate",
    lambda t: orders(t).select("o_orderkey", (F.col("value") * deflator(
        orders(t).groupBy("year").agg((F.sum("value") / F.count(F.lit(1))).alias("index")), 2000, 1995)).alias("real")),
    f"""WITH i AS (SELECT year, sum(value) / count(*) AS x FROM ({ORDERS_SQL}) AS o GROUP BY year)
    SELECT o_orderkey, floor(o_totalprice) * ((SELECT x FROM i WHERE year = 2000) / (SELECT x FROM i WHERE year = 1995)) AS real FROM orders""")
add("q_unit_factors",
    lambda t: t.base("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        "c_nationkey", (F.col("n") * C.EJ_TO_GJ).alias("gj"), (F.col("n") * C.THOUSAND_PERSONS).alias("persons"),
        (F.col("n") * C.PCAL_TO_KCAL / F.lit(1e6) / C.DAYS_PER_YEAR).alias("kcal"), (F.col("n") / C.MT_PER_GT).alias("gt"),
        (F.col("n") * C.PERCENT).alias("percent")),
    """SELECT c_nationkey, n * 1e9 AS gj, n * 1e3 AS persons, n * 1e12 / 1e6 / 365 AS kcal, n / 1000 AS gt, n * 100 AS percent
    FROM (SELECT c_nationkey, count(*) * 1e0 AS n FROM customer GROUP BY c_nationkey) AS x""")

# ---- reshape ----------------------------------------------------------------------------------

YEARS = {f"y{y}": y for y in range(1995, 2002)}
add("q_pivot_year_checked",
    lambda t: pivot_cells(yearly(t), ["scenario", "l_linenumber"], "year", YEARS),
    f"SELECT {RAW_SQL} AS scenario, l_linenumber, " + ", ".join(
        f"sum(l_quantity) FILTER (WHERE year(l_shipdate) = {y}) AS {n}" for n, y in YEARS.items()) + " FROM lineitem GROUP BY 1, 2")
add("q_unpivot_nulls",
    lambda t: to_long(
        t.base("part").select("p_partkey", F.nullif("p_size", F.lit(5)).cast("double").alias("size"), F.col("p_retailprice").alias("price")),
        ["p_partkey"], None, "what", "v"),
    """SELECT p_partkey, 'size' AS what, CAST(nullif(p_size, 5) AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""")
add("q_wide_years",
    lambda t: read_wide_years(pivot_sums(lines(t), ["l_suppkey"], "year", {f"X{y}": y for y in range(1995, 2002)}, "l_quantity"), ["l_suppkey"]),
    f"""SELECT s.l_suppkey, y.year, v AS value FROM (SELECT DISTINCT l_suppkey FROM lineitem) AS s CROSS JOIN
    (SELECT CAST(unnest(generate_series(1995, 2001)) AS INT) AS year) AS y LEFT JOIN
    (SELECT l_suppkey, {SHIP_YEAR} AS year, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) AS q ON q.l_suppkey = s.l_suppkey AND q.year = y.year""")

# ---- classes ------------------------------------------------------------------------------------

add("q_class_fixed",
    lambda t: fixed_class(t.base("customer").select("c_custkey", F.col("c_acctbal").alias("value")), C.INCOME_BREAKS),
    """SELECT c_custkey, c_acctbal AS value, CASE WHEN c_acctbal < 1 THEN 0 WHEN c_acctbal < 2.17 THEN 1 WHEN c_acctbal < 10 THEN 2
    WHEN c_acctbal < 30 THEN 3 WHEN c_acctbal < 50 THEN 4 WHEN c_acctbal < 70 THEN 5 WHEN c_acctbal < 100 THEN 6
    WHEN c_acctbal < 500 THEN 7 WHEN c_acctbal < 1000 THEN 8 ELSE 9 END AS class FROM customer""")
BALANCES = """SELECT c_custkey, CASE c_custkey % 50 WHEN 1 THEN floor(c_acctbal / 1000) * 1000 WHEN 2 THEN CAST('NaN' AS DOUBLE)
    ELSE c_acctbal END AS value FROM customer"""


def balances(t) -> DataFrame:
    """Account balances; some lie on a round number, some are not numbers."""
    kind, value = F.col("c_custkey") % 50, F.col("c_acctbal")
    odd = F.when(kind == 1, F.floor(value / 1000) * 1000).when(kind == 2, F.lit(float("nan"))).otherwise(value)
    return t.base("customer").select("c_custkey", odd.cast("double").alias("value"))


add("q_class_pretty", lambda t: pretty_class(balances(t)), f"WITH b AS ({BALANCES}) {pretty('b')}")
add("q_class_kmeans",
    lambda t: kmeans_class(t.base("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("value")), 4),
    f"WITH b AS (SELECT c_nationkey, avg(c_acctbal) AS value FROM customer GROUP BY ALL) {kmeans('b', 4)}")

# ---- files: written to the shared folder and read back ---------------------------------------------


CUSTOMER_SCHEMA = "custkey bigint, name string, nation int, balance double, segment string"


def csv_round_trip(t) -> DataFrame:
    """CSV written with `NA` and a sentinel, in another order and with a column to spare, read back by name."""
    path, balance = fresh(t, "customer-csv"), F.col("c_acctbal")
    text = F.when(balance >= 0, F.when(balance >= 100, balance.cast("string")).otherwise("#N/A"))
    write_report(t.base("customer").select(
        F.col("c_mktsegment").alias("Segment"), text.alias("balance"), F.lit("x").alias("spare"),
        F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_custkey").alias("custkey")), path)
    return read_csv(t.spark, path, CUSTOMER_SCHEMA)


add("s1_csv_source", csv_round_trip,
    """SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nation, CASE WHEN c_acctbal >= 100 THEN c_acctbal END AS balance,
    c_mktsegment AS segment FROM customer""")


def sentinel_round_trip(t) -> DataFrame:
    """Sizes written as text with a mark for missing ones."""
    path, size = fresh(t, "sizes-csv"), F.col("p_size")
    write_report(t.base("part").select("p_partkey", F.when(size % 7 == 0, "#N/A").otherwise(size.cast("string")).alias("v")), path)
    return read_csv(t.spark, path, "p_partkey bigint, v double")


def preamble_round_trip(t) -> DataFrame:
    """Text file with two lines before its header, one of which is also a line of data."""
    path = fresh(t, "segment-text")
    rows = t.base("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("c_acctbal")).alias("v"))
    body = rows.select(F.concat_ws(",", "c_mktsegment", "n", "v").alias("value"), F.lit(1).alias("o"))
    front = t.spark.createDataFrame(
        [("first line", -3), ("second,1,2", -2), ("segment,n,v", -1), ("second,1,2", 2)], "value string, o int")
    front.union(body).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return read_csv_after(t.spark, path, "segment string, n bigint, v bigint", 2)


add("s2_csv_after_preamble", preamble_round_trip,
    """SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(floor(c_acctbal)) AS BIGINT) AS v FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'second', 1, 2""")


def stored_project(t) -> Project:
    root = fresh(t, "project")
    rows = lines(t).select("scenario", "year", F.col("l_quantity").alias("value"), F.lit("unit").alias("Units"))
    Project.save(rows, root, "line quantities")
    Project.save(orders(t).select(F.lit("RegGHGPol_Ineq").alias("scenario"), "year", "value"), root, "order totals")
    return Project.from_parquet(t.spark, root)


add("s4_named_table",
    lambda t: stored_project(t).query("line quantities", "value").groupBy("scenario", "year").agg(strict_sum("value").alias("value")),
    f"SELECT {RAW_SQL} AS scenario, {SHIP_YEAR} AS year, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
add("s5_project_scenarios", lambda t: stored_project(t).scenarios(), f"SELECT DISTINCT {RAW_SQL} AS scenario FROM lineitem")


def sheet_round_trip(t) -> DataFrame:
    """Two sheets as CSV, read as a workbook and put beside each other."""
    paths = {"CO2": fresh(t, "sheet-co2"), "target": fresh(t, "sheet-target")}
    write_report(pivot_sums(lines(t), ["l_suppkey"], "year", {f"y{y}": y for y in (1996, 2000)}, "l_quantity"), paths["CO2"])
    write_report(t.base("supplier").select("s_suppkey", "s_nationkey"), paths["target"])
    book = read_sheets(t.spark, paths, {"CO2": "suppkey bigint, v1996 double, v2000 double", "target": "suppkey bigint, nation int"})
    return book["target"].join(book["CO2"].na.drop("any"), "suppkey", "left")


add("s6_sheets", sheet_round_trip,
    """SELECT s_suppkey AS suppkey, s_nationkey AS nation, CASE WHEN v2000 IS NOT NULL THEN v1996 END AS v1996, CASE WHEN v1996 IS NOT NULL THEN v2000 END AS v2000
    FROM supplier LEFT JOIN (SELECT l_suppkey,
    sum(l_quantity) FILTER (WHERE year(l_shipdate) = 1996) AS v1996, sum(l_quantity) FILTER (WHERE year(l_shipdate) = 2000) AS v2000
    FROM lineitem GROUP BY l_suppkey) AS x ON l_suppkey = s_suppkey""")


def caps_round_trip(t) -> DataFrame:
    """Caps written as nested XML per nation, one of them without caps, and read back flat."""
    path = fresh(t, "caps-xml")
    caps = customer_rows(t).groupBy("c_nationkey", "year").agg(strict_sum("value").alias("cap"))
    nested = strict_lookup(
        caps.withColumnRenamed("c_nationkey", "n_nationkey"), t.base("nation").select("n_nationkey", "n_name"), ["n_nationkey"], unique=True
    ).groupBy("n_name").agg(F.collect_list(F.struct(F.col("cap").alias("_VALUE"), F.col("year").alias("_year"))).alias("constraint"))
    nested.unionByName(
        t.base("nation").where("n_nationkey = 0").select(F.lit("Nowhere").alias("n_name")), allowMissingColumns=True
    ).select(F.col("n_name").alias("_name"), F.struct(
        F.lit("GHG").alias("_name"), F.col("n_name").alias("market"), "constraint").alias("ghgpolicy")).write.format("xml").option(
        "rowTag", "region").option("rootTag", "world").save(path)
    return policy_caps(t.spark, path)


add("s9_xml_caps", caps_round_trip,
    f"""SELECT n_name AS region, n_name AS market, 'GHG' AS policy, year, sum(value) AS cap FROM ({CUSTOMER_SQL}) AS c
    JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, year UNION ALL SELECT 'Nowhere', 'Nowhere', 'GHG', NULL, NULL""")


def targets_round_trip(t) -> DataFrame:
    """Targets with a comma inside a quoted label."""
    path = fresh(t, "targets-csv")
    write_report(lines(t).groupBy("year").agg(strict_sum("l_quantity").alias("value")).select(
        F.lit("World").alias("region"), "year", "value", F.lit("NDC,date=2023").alias("sce"), F.lit("MtCO2e").alias("Units")), path)
    return policy_targets(t.spark, path)


add("s10_policy_targets", targets_round_trip,
    f"""SELECT 'NDC,date=2023' AS sce, 'World' AS region, {SHIP_YEAR} AS year, 'MtCO2e' AS "Units", sum(l_quantity) AS value FROM lineitem GROUP BY 3""")


def result_round_trip(t) -> DataFrame:
    path = fresh(t, "result")
    write_table(compare(sector_rows(t), ["year", "sector", "Units"], POLICY), path, ["scenario"])
    return t.spark.read.parquet(path)


add("k1_result_sink", result_round_trip, OPS["q_diff_baseline"].sql)
add("k2_report_table",
    lambda t: report_table(
        spread(lines(t), ["year"], POLICY, "l_extendedprice").select(
            "year", *POLICY.names, ((F.col("Gini25") - F.col("Baseline")) / F.col("Baseline") * 100).alias("%Diff_Gini25")),
        rounded={n: 0 for n in POLICY.names}, percent={"%Diff_Gini25": 1}),
    f"""WITH r AS (SELECT {NAME_SQL} AS scenario, {SHIP_YEAR} AS year, l_extendedprice AS value FROM lineitem), w AS ({wide("r", "year")})
    SELECT year, round_even(b, 0) AS "Baseline", round_even(g25, 0) AS "Gini25", round_even(g50, 0) AS "Gini50",
    {number_sql('(g25 - b) / b * 100', 1)} || '%' AS "%Diff_Gini25" FROM w""")
add("k3_chart_table",
    lambda t: chart_table(compare(sector_rows(t), ["year", "sector"], POLICY), {"sector": ("ECONOMY", "SMALL", "LARGE"), "scenario": POLICY.variants}),
    f"""WITH r AS ({SECTOR_SQL}), w AS ({wide("r", "year, sector")}) SELECT *, CASE sector WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 END AS sector_level,
    CASE scenario WHEN 'Gini25' THEN 1 ELSE 2 END AS scenario_level FROM ({long("w", "year, sector")}) AS x""")
add("k4_map_table",
    lambda t: map_table(customer_rows(t).groupBy("c_nationkey", "segment", "year").agg(strict_sum("value").alias("total")),
                        "c_nationkey", "total", **{"class": "segment"}),
    f"""SELECT c_nationkey AS "subRegion", segment AS class, year, sum(value) AS value FROM ({CUSTOMER_SQL}) AS x GROUP BY ALL""")
