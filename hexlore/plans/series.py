"""Queries over quarterly series, event counts and the wide feature table. A nation is a cell, a supplier a building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlore.functions import nulls
from hexlore.operators import events, features, geo, shape
from hexlore.operators.score import categorise
from hexlore.plans.registry import query, r6, rounded, table

RENT = """rent AS (SELECT CAST(s_nationkey AS BIGINT) AS cell, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, median(l_extendedprice) AS v, count(DISTINCT l_suppkey) AS n_units
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
CHANGES = RENT + """, ch AS (SELECT *, (v - lag(v, 4) OVER w) / nullif(lag(v, 4) OVER w, 0) * 100 AS change_1yr, (v - lag(v, 20) OVER w) / nullif(lag(v, 20) OVER w, 0) * 100 AS change_5yr
FROM rent WINDOW w AS (PARTITION BY cell ORDER BY period))"""
YEARS = (1998, 1999, 2000, 2001)
QUARTERS = [f"{y}_q{q}" for y in YEARS for q in range(1, 5)]
PICKS = {"first": "rent_1998_q1", "mid": "rent_1999_q4", "later": "rent_2000_q1", "recent": "rent_2000_q4", "last": "rent_2001_q4"}
WIDE = RENT + ", wide AS (SELECT cell, " + ", ".join(f"max(CASE WHEN year(period) = {q[:4]} AND quarter(period) = {q[-1]} THEN v END) AS rent_{q}" for q in QUARTERS) + ", median(v) AS median_rent FROM rent GROUP BY cell)"


def lines(spark, d) -> DataFrame:
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("cell"))
    li = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", events.quarter_start("l_shipdate").alias("period"))
    return li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def rent(spark, d) -> DataFrame:
    return events.series(lines(spark, d), ["cell"], "period", "l_extendedprice", "l_suppkey").withColumnRenamed("median_value", "v")


def rent_changes(spark, d) -> DataFrame:
    return events.with_changes(rent(spark, d), ["cell"], "period", "v", {"change_1yr": 4, "change_5yr": 20})


def wide(spark, d) -> DataFrame:
    s = rent(spark, d)
    named = s.select("cell", "v", F.concat(F.lit("rent_"), F.year("period").cast("string"), F.lit("_q"), F.quarter("period").cast("string")).alias("q"))
    return shape.pivot_wider(named, ["cell"], "q", "v", [f"rent_{q}" for q in QUARTERS]).join(s.groupBy("cell").agg(F.median("v").alias("median_rent")), "cell")


@query(f"WITH {CHANGES} SELECT cell, period, round(v, 6) AS v, n_units, round(change_1yr, 6) AS change_1yr, round(change_5yr, 6) AS change_5yr FROM ch")
def rent_series_change(spark, d):
    return rounded(rent_changes(spark, d), "v", "change_1yr", "change_5yr")


@query(f"""WITH {CHANGES} SELECT cell, period, round(change_1yr, 6) AS change_1yr FROM (SELECT *, rank() OVER (PARTITION BY cell ORDER BY period DESC NULLS LAST) AS k FROM ch)
WHERE k = 1""")
def rent_latest_ties(spark, d):
    return events.snapshot(rent_changes(spark, d), ["cell"], "period").select("cell", "period", r6("change_1yr").alias("change_1yr"))


FLAGSHIP = f"""WITH {CHANGES}, last AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY cell ORDER BY period DESC NULLS LAST) AS k FROM ch) WHERE k = 1),
sc AS (SELECT cell, (change_1yr - min(change_1yr) OVER ()) / nullif(max(change_1yr) OVER () - min(change_1yr) OVER (), 0) * 100 AS score FROM last)
SELECT cell, round(score, 6) AS score, CASE WHEN round(score, 6) <= 25 THEN 'Low' WHEN round(score, 6) <= 50 THEN 'Moderate' WHEN round(score, 6) <= 75 THEN 'High'
WHEN round(score, 6) > 75 THEN 'Very High' END AS category FROM sc"""


@query(FLAGSHIP)
def rent_pressure_scores(spark, d):
    last = events.snapshot(rent_changes(spark, d), ["cell"], "period")
    return nulls.with_minmax100(last, {"score": "change_1yr"}).select("cell", r6("score").alias("score")).withColumn("category", categorise(F.col("score")))


@query(f"""WITH {RENT}, c AS (SELECT a.cell, a.period, (a.v - b.v) / nullif(b.v, 0) * 100 AS x FROM rent a LEFT
JOIN rent b ON a.cell = b.cell AND b.period = CAST(a.period - INTERVAL 12 MONTH AS DATE))
SELECT cell, period, round(x, 6) AS change_calendar FROM c""")
def rent_calendar_change(spark, d):
    return events.with_calendar_change(rent(spark, d), ["cell"], "period", "v", 12, "change_calendar").select("cell", "period", r6("change_calendar").alias("change_calendar"))


def rent_sql(p=PICKS) -> str:
    f, m, lt, rc, la = p["first"], p["mid"], p["later"], p["recent"], p["last"]
    e, late = f"(({m} - {f}) / 4)", f"(({la} - {lt}) / 4)"
    vals = "list_filter([" + ", ".join(f"rent_{q}" for q in QUARTERS) + "], lambda x: x IS NOT NULL)"
    return f"""rf AS (SELECT *, CASE WHEN {f} > 0 THEN ({la} - {f}) / {f} * 100 END AS rent_change_total, CASE
WHEN {rc} > 0 THEN ({la} - {rc}) / {rc} * 100 END AS rent_change_recent,
CASE WHEN {e} > 0 THEN ({late} - {e}) / {e} * 100 END AS rent_acceleration, CASE
WHEN len({vals}) >= 3 AND list_avg({vals}) > 0 THEN list_stddev_samp({vals}) / list_avg({vals}) END AS rent_volatility,
{la} AS rent_current, CASE WHEN median_rent > 0 THEN {la} / median_rent END AS rent_level_ratio FROM wide)"""


def rent_table(spark, d) -> DataFrame:
    return features.rent_features(wide(spark, d), **PICKS, values=[f"rent_{q}" for q in QUARTERS], median="median_rent")


RENT_OUT = ["rent_change_total", "rent_change_recent", "rent_acceleration", "rent_current", "rent_level_ratio"]


@query(f"WITH {WIDE}, {rent_sql()} SELECT cell, {', '.join(f'round({c}, 6) AS {c}' for c in RENT_OUT)} FROM rf")
def rent_wide_quarters(spark, d):
    return rounded(rent_table(spark, d), *RENT_OUT).select("cell", *RENT_OUT)


@query(f"WITH {WIDE}, {rent_sql()} SELECT cell, round(rent_volatility, 6) AS rent_volatility FROM rf")
def rent_volatility_row(spark, d):
    return rent_table(spark, d).select("cell", r6("rent_volatility").alias("rent_volatility"))


@query("""WITH y AS (SELECT o_custkey % 50 AS cell, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2), a AS (SELECT cell, list(s ORDER BY y) AS l
FROM y GROUP BY cell)
SELECT CAST(cell AS BIGINT) AS cell, round(CASE WHEN len(l) >= 2 THEN (l[-1] - l[1]) / l[1] * 100 END, 6) AS rate, round(CASE
WHEN len(l) >= 3 THEN list_avg([l[i + 2] - 2 * l[i + 1] + l[i] for i in range(1, len(l) - 1)]) END, 4) AS accel,
round(CASE WHEN len(l) >= 2 THEN list_stddev_samp(l) / list_avg(l) END, 6) AS vol FROM a""")
def rate_accel_helpers(spark, d):
    y = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("cell"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"))
    a = y.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "s"))), lambda x: x["s"]).alias("l"))
    return a.select(
        "cell", r6(nulls.rate_of_change(F.col("l"))).alias("rate"), F.round(nulls.acceleration(F.col("l")), 4).alias("accel"),
        r6(nulls.volatility(F.col("l"))).alias("vol"),
    )


COUNT_YEARS = list(range(1995, 2002))
COUNTS = "counts AS (SELECT c_custkey, count(o_orderkey) AS demo_count_total, " + ", ".join(f"count(CASE WHEN year(o_orderdate) = {y} THEN 1 END) AS demo_count_{y}" for y in COUNT_YEARS) + " FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"


def counts(spark, d) -> DataFrame:
    cells = table(spark, d, "customer").select("c_custkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    return events.counts_by_year(cells, orders, "c_custkey", "year", COUNT_YEARS, "demo_count")


@query(f"WITH {COUNTS} SELECT * FROM counts")
def event_counts_by_year(spark, d):
    return counts(spark, d)


DEMO = f"""{COUNTS}, demo AS (SELECT c_custkey, demo_count_total / 2.5 AS demo_density, demo_count_2000 + demo_count_2001 AS demo_recent,
CASE WHEN demo_count_1999 > 0 THEN ((demo_count_2000 + demo_count_2001) / 2 - demo_count_1999) / demo_count_1999 END AS demo_trend, CASE
WHEN demo_count_2000 + demo_count_2001 > 0 THEN 1 ELSE 0 END AS has_recent_demos FROM counts)"""


def demo(spark, d) -> DataFrame:
    return features.demo_features(counts(spark, d), "demo_count_total", "demo_count_1999", "demo_count_2000", "demo_count_2001", F.lit(2.5))


@query(f"WITH {DEMO} SELECT c_custkey, round(demo_density, 6) AS demo_density, demo_recent, round(demo_trend, 6) AS demo_trend, has_recent_demos FROM demo")
def demo_features(spark, d):
    return rounded(demo(spark, d), "demo_density", "demo_trend").select("c_custkey", "demo_density", "demo_recent", "demo_trend", "has_recent_demos")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PIVOT = "p AS (SELECT CAST(c_nationkey AS BIGINT) AS cell, " + ", ".join(f"sum(CASE WHEN c_mktsegment = '{s}' THEN c_acctbal END) AS {s.lower()}" for s in SEGMENTS) + ", sum(c_acctbal) AS total FROM customer GROUP BY 1)"
PARTS = {"pct_building": (["building"], "total"), "pct_home": (["furniture", "household"], "total")}


def segments(spark, d) -> DataFrame:
    tidy = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("cell"), F.lower("c_mktsegment").alias("variable")).agg(F.sum("c_acctbal").alias("estimate"))
    out = shape.pivot_wider(tidy, ["cell"], "variable", "estimate", [s.lower() for s in SEGMENTS])
    return out.join(tidy.groupBy("cell").agg(F.sum("estimate").alias("total")), "cell")


@query(f"""WITH {PIVOT} SELECT cell, round(building / nullif(total, 0) * 100, 6) AS pct_building, round((furniture + household) / nullif(total, 0) * 100, 6) AS pct_home,
round((total - building) / nullif(total, 0) * 100, 6) AS pct_other FROM p""")
def tidy_pivot_shares(spark, d):
    s = features.shares(segments(spark, d), PARTS).withColumn("pct_other", nulls.pct(F.col("total") - F.col("building"), "total"))
    return rounded(s, "pct_building", "pct_home", "pct_other").select("cell", "pct_building", "pct_home", "pct_other")


@query(f"WITH {PIVOT} SELECT cell, variable, round(v, 4) AS value FROM (SELECT cell, unnest(['building', 'household', 'machinery']) AS variable, unnest([building, household, machinery]) AS v FROM p)")
def unpivot_shares(spark, d):
    return shape.pivot_longer(segments(spark, d), ["cell"], ["building", "household", "machinery"]).withColumn("value", F.round("value", 4))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE
WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority
FROM orders), n AS (SELECT count(*) AS n, count(price) AS a, count(priority) AS b, count(o_orderkey) AS c FROM t)
SELECT unnest(['o_orderkey', 'price', 'priority']) AS variable, round(unnest([(n - c) * 100.0 / n, (n - a) * 100.0 / n, (n - b) * 100.0 / n]), 6) AS pct_missing
FROM n""")
def missing_profile(spark, d):
    t = gappy(spark, d)
    return rounded(shape.missing_profile(t, ["o_orderkey", "price", "priority"]), "pct_missing")


def gappy(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("priority"),
    )


@query("""SELECT s AS l_suppkey, round(CASE WHEN count(e) = count(*) THEN sum(e) END, 2) AS estimate FROM (SELECT l_suppkey AS s, CASE WHEN (l_orderkey * 31 + l_linenumber) % 997 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS e FROM lineitem) GROUP BY s""")
def strict_weighted_sum(spark, d):
    e = F.when((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 997 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, d, "lineitem").select("l_suppkey", e.alias("e")).groupBy("l_suppkey").agg(F.round(nulls.strict_sum("e"), 2).alias("estimate"))


@query("SELECT s_suppkey, s_nationkey, s_name, CAST(dense_rank() OVER (ORDER BY s_nationkey) AS INTEGER) AS building_id FROM supplier")
def building_ids(spark, d):
    return events.dense_ids(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name"), ["s_nationkey"], "building_id")


@query("""WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), one AS (SELECT n_nationkey AS k, n_nationkey * 1.5 AS x, n_nationkey * 2.0 AS y FROM nation
WHERE n_nationkey % 3 <> 0), two AS (SELECT n_nationkey AS k, n_nationkey + 100.0 AS x, n_nationkey + 200.0 AS y FROM nation WHERE n_nationkey % 5 <> 0)
SELECT s_suppkey, round(CAST(coalesce(one.x, two.x) AS DOUBLE), 6) AS x, round(CAST(coalesce(one.y, two.y) AS DOUBLE), 6) AS y FROM supplier LEFT
JOIN one ON s_nationkey = one.k LEFT JOIN two ON s_nationkey = two.k""")
def geocode_fallback(spark, d):
    places = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    one = nation.where(n % 3 != 0).select(n.alias("k"), (n * 1.5).alias("x"), (n * 2.0).alias("y"))
    two = nation.where(n % 5 != 0).select(n.alias("k"), (n + 100.0).alias("x"), (n + 200.0).alias("y"))
    # Each address is looked up once, however many buildings it has.
    found = events.geocode(places.select("k").distinct(), "k", one, two)
    return rounded(places.join(found, "k"), "x", "y").select("s_suppkey", "x", "y")


TEXT = "CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE year(o_orderdate) || ' Q' || quarter(o_orderdate) || CASE WHEN o_orderkey % 5 = 0 THEN ' QTD' ELSE '' END END"


@query(f"""SELECT o_orderkey, CASE WHEN t = 'unknown' THEN NULL ELSE make_date(CAST(substr(t, 1, 4) AS INTEGER), (CAST(substr(t, 7, 1) AS INTEGER) - 1) * 3 + 1, 1) END AS period
FROM (SELECT o_orderkey, {TEXT} AS t FROM orders)""")
def period_parse(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.expr(TEXT).alias("t"))
    return t.select("o_orderkey", events.parse_quarter(F.col("t")).alias("period"))


CELL = f"""{PIVOT}, {WIDE}, {rent_sql()}, dc AS (SELECT CAST(c_nationkey AS BIGINT) AS cell, count(o_orderkey) AS n_orders FROM customer LEFT
JOIN orders ON c_custkey = o_custkey GROUP BY 1),
base AS (SELECT p.cell, total AS income, building / nullif(total, 0) * 100 AS renters, household / nullif(total, 0) * 100 AS poverty, CASE
WHEN p.cell % 6 = 0 THEN NULL ELSE machinery / nullif(total, 0) * 100 END AS college, median_rent, rent_change_total, rent_level_ratio, n_orders / 2.5 AS demo_density
FROM p JOIN dc ON p.cell = dc.cell LEFT JOIN rf ON p.cell = rf.cell),
mm AS (SELECT *, CASE WHEN income > 0 THEN median_rent * 12 / income END AS rent_burden_proxy, (max(income) OVER () - income) / nullif(max(income) OVER () - min(income) OVER (), 0) * 100 AS vuln_low_income, (renters - min(renters) OVER ()) / nullif(max(renters) OVER () - min(renters) OVER (), 0) * 100 AS vuln_high_rent,
(poverty - min(poverty) OVER ()) / nullif(max(poverty) OVER () - min(poverty) OVER (), 0) * 100 AS vuln_poverty, (max(college) OVER () - college) / nullif(max(college) OVER () - min(college) OVER (), 0) * 100 AS vuln_low_edu FROM base),
vul AS (SELECT *, (vuln_low_income + vuln_high_rent + vuln_poverty + vuln_low_edu) / 4 AS vulnerability_index FROM mm),
spot AS (SELECT cell, ((cell * 7919) % 10007) / 10007.0 AS x, ((cell * 104729) % 10007) / 10007.0 AS y
FROM vul), nn AS (SELECT a.cell, b.cell AS other, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.cell) AS k FROM spot a
JOIN spot b ON a.cell <> b.cell),
lg AS (SELECT nn.cell, avg(rent_change_total) AS rent_change_total_lag, avg(demo_density) AS demo_density_lag, avg(income) AS income_lag, avg(vulnerability_index) AS vulnerability_index_lag FROM nn JOIN vul ON other = vul.cell WHERE k <= 6 GROUP BY nn.cell),
lagged AS (SELECT vul.*, rent_change_total_lag, demo_density_lag, income_lag, vulnerability_index_lag FROM vul LEFT JOIN lg ON vul.cell = lg.cell),
feat AS (SELECT *, rent_change_total * vulnerability_index AS rent_vuln_interaction, demo_density * rent_level_ratio AS demo_rent_interaction, vuln_low_income * rent_burden_proxy AS income_burden_interaction, (rent_change_total + rent_change_total_lag) / 2 AS neighborhood_rent_pressure FROM lagged)"""
VULN = ["rent_burden_proxy", "vuln_low_income", "vuln_high_rent", "vuln_poverty", "vuln_low_edu", "vulnerability_index"]
INTER = ["rent_vuln_interaction", "demo_rent_interaction", "income_burden_interaction", "neighborhood_rent_pressure"]
LAGGED = ["rent_change_total", "demo_density", "income", "vulnerability_index"]
FEATURES = ["rent_change_total", "rent_level_ratio", "demo_density", *VULN, *INTER]


def vulnerable(spark, d) -> DataFrame:
    """The cell table up to the vulnerability index."""
    seg = segments(spark, d)
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    dc = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_nationkey").cast("long").alias("cell")).agg(F.count("o_orderkey").alias("n_orders"))
    pct = lambda c: nulls.pct(c, "total")
    base = seg.join(dc, "cell").join(rent_table(spark, d).select("cell", "median_rent", "rent_change_total", "rent_level_ratio"), "cell", "left")
    base = base.select(
        "cell", F.col("total").alias("income"), pct("building").alias("renters"), pct("household").alias("poverty"),
        F.when(F.col("cell") % 6 != 0, pct("machinery")).alias("college"), "median_rent", "rent_change_total", "rent_level_ratio",
        (F.col("n_orders") / 2.5).alias("demo_density"),
    )
    return features.vulnerability(base, "income", "renters", "poverty", "college", "median_rent")


def cell_table(spark, d) -> DataFrame:
    out = vulnerable(spark, d)
    x, y = geo.pseudo_xy("cell")
    return features.interactions(features.neighbourhood(out.withColumns({"x": x, "y": y}), "cell", LAGGED)).drop("x", "y")


def listed(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query(f"WITH {CELL} SELECT cell, {listed(VULN)} FROM feat")
def vulnerability_index(spark, d):
    return rounded(vulnerable(spark, d), *VULN).select("cell", *VULN)


@query(f"WITH {CELL} SELECT cell, {listed(INTER)} FROM feat")
def interactions(spark, d):
    return rounded(cell_table(spark, d), *INTER).select("cell", *INTER)


LAGS = [f"{c}_lag" for c in LAGGED]


@query(f"WITH {CELL} SELECT cell, {listed(LAGS)} FROM feat")
def feature_lags(spark, d):
    """The means of four features over the six nearest cells."""
    return rounded(cell_table(spark, d), *LAGS).select("cell", *LAGS)


COUNT_MISSING = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FEATURES)


@query(f"""WITH {CELL} SELECT cell, CAST(m AS INTEGER) AS missing_feature_count,
round(m * 100.0 / {len(FEATURES)}, 6) AS missing_feature_pct, m * 100.0 / {len(FEATURES)} < 50 AS sufficient_data FROM (SELECT cell, {COUNT_MISSING} AS m FROM feat)""")
def sufficient_data_flag(spark, d):
    out = shape.with_missing_flags(cell_table(spark, d), FEATURES)
    return rounded(out, "missing_feature_pct").select("cell", F.col("missing_feature_count").cast("int").alias("missing_feature_count"), "missing_feature_pct", "sufficient_data")


NAMES = [*FEATURES, "rent_change_total_lag", "pct_poc", "demo_trend", "vuln_poverty_lag", "x_interaction"]


@query("WITH n AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + """]) AS feature) SELECT feature, CASE
WHEN feature LIKE 'rent\\_%' ESCAPE '\\' AND feature NOT LIKE '%\\_lag' ESCAPE '\\' THEN 'Temporal Rent'
WHEN feature LIKE 'demo\\_%' ESCAPE '\\' AND feature NOT LIKE '%\\_lag' ESCAPE '\\' THEN 'Demolitions'
WHEN feature LIKE 'vuln\\_%' ESCAPE '\\' OR feature = 'vulnerability_index' THEN 'Vulnerability' WHEN feature LIKE '%\\_lag' ESCAPE '\\' THEN 'Spatial Lag'
WHEN feature LIKE '%\\_interaction' ESCAPE '\\' THEN 'Interactions' ELSE 'Other' END AS category FROM n""")
def feature_catalog(spark, d):
    names = spark.createDataFrame([(n,) for n in NAMES], "feature string")
    return names.withColumn("category", features.category(F.col("feature")))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT o_orderkey, price FROM t WHERE price IS NOT NULL""")
def column_drop_by_missing(spark, d):
    t = gappy(spark, d).drop("o_custkey", "priority").withColumn("mostly_missing", F.when(F.col("o_orderkey") % 3 == 0, F.col("price")))
    out, left = shape.drop_sparse(t, ["price", "mostly_missing"])
    return out.na.drop(subset=left)


@query("SELECT CAST(c_nationkey AS BIGINT) AS cell, c_custkey FROM (SELECT *, md5(c_custkey || '|42') AS h FROM customer ORDER BY h, c_custkey LIMIT 1000)")
def sample_1000(spark, d):
    return shape.sample_rows(table(spark, d, "customer"), "c_custkey").select(F.col("c_nationkey").cast("long").alias("cell"), "c_custkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2")
def group_shares(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))))


@query("""SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, CAST(NULL AS INTEGER) AS size FROM supplier UNION ALL SELECT p_partkey, p_name, CAST(NULL AS DOUBLE), p_size
FROM part""")
def bind_rows_by_name(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return shape.bind_rows(a, b)


@query("""SELECT c_custkey, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 4 <> 0, false) AS high, coalesce(CASE
WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, 'NA') || ':' || CAST(c_nationkey AS VARCHAR) AS tag FROM customer""")
def membership_and_paste(spark, d):
    seg = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", nulls.is_in(seg, ["BUILDING", "MACHINERY"]).alias("high"), nulls.paste(":", seg, "c_nationkey").alias("tag"))


@query("SELECT CAST(NULL AS DOUBLE) AS eviction_rate, n_nationkey, CAST(NULL AS BIGINT) AS eviction_count FROM nation")
def planned_columns(spark, d):
    return shape.null_columns(table(spark, d, "nation").select("n_nationkey"), {"eviction_rate": "double", "eviction_count": "bigint"})
