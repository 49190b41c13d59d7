"""Queries on research gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..operators import research as R
from ..registry import query
from ..sources.tables import EVENT_BARS_SQL, epoch, event_bars, table
from .bars import rounded

_ROWS = "FROM lineitem"


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as gate rows: id, sym, since, value, success, seq."""
    from ..sources.tables import epoch

    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("sym"), epoch(F.col("l_shipdate")).alias("since"), (F.col("l_discount") - F.col("l_tax")).alias("value"),
        (F.col("l_discount") >= 0.05).alias("success"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


@query("""WITH p AS (SELECT l_orderkey AS id, l_discount >= 0.05 AS success FROM lineitem WHERE l_linenumber = 1), c AS (SELECT l_orderkey AS id, last(l_discount >= 0.05 ORDER BY l_linenumber * 100000000 + l_partkey) AS control FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber > 1 GROUP BY 1)
SELECT count(*) AS eligible, CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS hits, CAST(sum(CAST(control AS INTEGER)) AS BIGINT) AS control_hits, round(sum(CAST(success AS INTEGER)) / sum(CAST(control AS INTEGER)), 6) AS lift FROM p JOIN c USING (id)""")
def matched_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate_rows(spark, sf_dir)
    return rounded(R.matched_lift(rows.where("seq = 1"), rows.where("flag = 'N' AND seq > 1").select("id", "success", (F.col("seq") * F.lit(100_000_000) + F.col("part")).alias("seq"))), {"lift": 6})


@query("""WITH r AS (SELECT *, CASE WHEN l_linestatus <> 'F' THEN 'unconfirmed' WHEN l_tax > 0.06 THEN 'protocol' WHEN l_quantity > 45 THEN 'policy' ELSE 'kept' END AS r FROM lineitem),
d AS (SELECT CASE WHEN r = 'kept' AND row_number() OVER (PARTITION BY l_orderkey, r ORDER BY l_linenumber) > 1 THEN 'duplicate' ELSE r END AS reason FROM r) SELECT reason, count(*) AS n FROM d GROUP BY 1""")
def cohort_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "id", "l_linenumber": "seq"})
    rules = [("unconfirmed", F.col("l_linestatus") != "F"), ("protocol", F.col("l_tax") > 0.06), ("policy", F.col("l_quantity") > 45)]
    return R.isolate(rows, rules).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CAST(floor(epoch(l_shipdate)) AS BIGINT) AS since, l_discount - l_tax AS value, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
m AS (SELECT month, CAST(floor((row_number() OVER (ORDER BY month) - 1) * 6 / count(*) OVER ()) AS INTEGER) AS fold FROM (SELECT DISTINCT month FROM r)),
f AS (SELECT fold, count(*) AS months, CAST(epoch(CAST(min(month) || '-01' AS TIMESTAMP)) AS BIGINT) AS start FROM m GROUP BY 1),
x AS (SELECT r.*, m.fold AS own FROM r JOIN m USING (month))
SELECT f.fold, f.months, count(CASE WHEN floor(since / 3600) * 3600 + 3600 <= start - 172800 THEN 1 END) AS n_train, count(CASE WHEN own = f.fold THEN 1 END) AS n_valid,
 round(avg(CASE WHEN floor(since / 3600) * 3600 + 3600 <= start - 172800 THEN value END), 6) AS mean_train, round(avg(CASE WHEN own = f.fold THEN value END), 6) AS mean_valid FROM x CROSS JOIN f GROUP BY 1, 2""")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # months are calendar months in UTC
    return rounded(R.walk_forward(gate_rows(spark, sf_dir), 6, 48 * 3600), {"mean_train": 6, "mean_valid": 6})


@query()
def bootstrap_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 30 days per flag; the random stream has no SQL, a test holds it against a plain loop."""
    rows = gate_rows(spark, sf_dir).withColumn("month", F.floor(F.col("since") / (30 * 86400)))
    return rounded(R.block_bootstrap(rows, ["flag"], ["month"], rounds=200), {"mean": 6, "lower": 6})


@query()
def bootstrap_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds by symbol and day and by symbol on one random stream, per flag; a test holds it against a plain loop."""
    return rounded(R.paired_bounds(gate_rows(spark, sf_dir), ["flag"]), {"event_lower": 6, "coin_lower": 6})


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT sym, t, close, row_number() OVER (PARTITION BY sym ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY sym) AS n FROM b)
SELECT a.sym, a.t AS since, round(a.close, 6) AS value, round(p.close, 6) AS placebo FROM r a JOIN r p ON a.sym = p.sym AND a.i = (p.i + CAST(floor(p.n / 3) AS BIGINT)) % p.n""")
def placebo_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_bars(spark, sf_dir).select("sym", F.col("t").alias("since"), F.col("close").alias("value"))
    return rounded(R.placebo(rows), {"value": 6, "placebo": 6})


_H = "h4 AS (PARTITION BY sym ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 14400 FOLLOWING), h12 AS (PARTITION BY sym ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 43200 FOLLOWING)"


@query(f"""{EVENT_BARS_SQL}, r AS (SELECT sym AS key, CASE WHEN close > open THEN 'event' ELSE 'control' END AS role, max(high) OVER h4 / nullif(close, 0) - 1 AS m4, max(high) OVER h12 / nullif(close, 0) - 1 AS m12 FROM b WINDOW {_H}),
g AS (SELECT key, role, target, horizon, CASE WHEN horizon = 'h4' THEN CAST(m4 >= target AS DOUBLE) ELSE CAST(m12 >= target AS DOUBLE) END AS hit FROM r CROSS JOIN (VALUES (0.5), (2.0)) x(target) CROSS JOIN (VALUES ('h4'), ('h12')) y(horizon))
SELECT key, CAST(target AS DOUBLE) AS target, horizon, count(CASE WHEN role = 'event' THEN hit END) AS n, round(avg(CASE WHEN role = 'event' THEN hit END), 6) AS hit_rate, round(avg(CASE WHEN role = 'control' THEN hit END), 6) AS baseline,
 round(avg(CASE WHEN role = 'event' THEN hit END) / nullif(avg(CASE WHEN role = 'control' THEN hit END), 0), 5) AS lift FROM g GROUP BY 1, 2, 3""")
def detector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    rows = O.forward(bars, 4 * 3600).withColumnRenamed("mfe", "mfe_h4").drop("mae", "ret", "seen")
    rows = O.forward(rows, 12 * 3600).withColumnRenamed("mfe", "mfe_h12")
    rows = rows.select(F.col("sym").alias("key"), F.when(F.col("close") > F.col("open"), "event").otherwise("control").alias("role"), "mfe_h4", "mfe_h12")
    return rounded(R.gate_summary(rows, [0.5, 2.0], ["h4", "h12"]), {"hit_rate": 6, "baseline": 6, "lift": 5})


@query("""WITH r AS (SELECT l_returnflag AS key, l_discount - l_tax AS value, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'valid' END AS part, f FROM lineitem, (VALUES ('small'), ('large'), ('final')) x(f)
 WHERE CASE f WHEN 'small' THEN l_quantity < 20 WHEN 'large' THEN l_quantity >= 30 ELSE l_linestatus = 'F' END),
c AS (SELECT key, f AS filter, count(CASE WHEN part = 'train' THEN 1 END) AS n_train, count(CASE WHEN part = 'valid' THEN 1 END) AS n_valid, avg(CASE WHEN part = 'train' THEN value END) AS train, avg(CASE WHEN part = 'valid' THEN value END) AS valid FROM r GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(train, 9) DESC, filter) AS place FROM c WHERE n_train >= 30) SELECT key, filter, n_train, n_valid, round(train, 6) AS train, round(valid, 6) AS valid FROM p WHERE place = 1""")
def remediation_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    names = F.array_compact(F.array(F.when(F.col("l_quantity") < 20, "small"), F.when(F.col("l_quantity") >= 30, "large"), F.when(F.col("l_linestatus") == "F", "final")))
    part = F.when(F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), "train").otherwise("valid")
    rows = line.select(F.col("l_returnflag").alias("key"), (F.col("l_discount") - F.col("l_tax")).alias("value"), part.alias("part"), F.explode(names).alias("filter"))
    return rounded(R.best_filter(rows, 30), {"train": 6, "valid": 6})


@query("""WITH s AS (SELECT o_orderpriority AS id, count(*) AS trades, avg(o_totalprice) AS mean, count(DISTINCT o_custkey) AS coins FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
r AS (SELECT *, list_filter([CASE WHEN NOT trades >= 1000 THEN 'trades' END, CASE WHEN NOT mean > 251000 THEN 'mean' END, CASE WHEN NOT coins >= 700 THEN 'coins' END], lambda x: x IS NOT NULL) AS reasons FROM s)
SELECT id, trades, round(mean, 4) AS mean, coins, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM r""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("id")).agg(F.count("*").alias("trades"), F.avg("o_totalprice").alias("mean"), F.count_distinct("o_custkey").alias("coins"))
    out = R.promotion(s, [("trades", F.col("trades") >= 1000), ("mean", F.col("mean") > 251000), ("coins", F.col("coins") >= 700)])
    return rounded(out.withColumn("reasons", F.array_join("reasons", ",")), {"mean": 4})


@query("""SELECT l_returnflag AS dataset, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY CUBE (1, 2)""")
def coverage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_suppkey AS sym, l_linestatus AS terminal, avg(l_discount) AS m, count(*) AS n, sum(l_discount) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT terminal, sum(n)::BIGINT AS events, round(sum(s) / sum(n), 6) AS per_event, round(avg(m), 6) AS per_coin FROM m GROUP BY 1""")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per event against the mean of the coins' means."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    m = rows.groupBy(F.col("l_suppkey").alias("sym"), F.col("l_linestatus").alias("terminal")).agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"), F.sum("l_discount").alias("s"))
    return rounded(m.groupBy("terminal").agg(F.sum("n").alias("events"), (F.sum("s") / F.sum("n")).alias("per_event"), F.avg("m").alias("per_coin")), {"per_event": 6, "per_coin": 6})


@query("""SELECT m.id, coalesce(s.n, 0) AS n, round(s.mean, 4) AS mean FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) m(id)
LEFT JOIN (SELECT o_orderpriority AS id, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1) s USING (id)""")
def strategy_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered strategies, also those without rows."""
    ids = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")], "id string")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return R.with_all(ids, found, "id").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""WITH d AS (SELECT l_orderkey AS id, count(*) AS n, count(DISTINCT concat(l_returnflag, l_linestatus)) AS sigs FROM lineitem GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'single' WHEN sigs = 1 THEN 'duplicate' ELSE 'conflicting' END AS kind, count(*) AS n FROM d GROUP BY 1""")
def selection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct(F.concat("l_returnflag", "l_linestatus")).alias("sigs"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("sigs") == 1, "duplicate").otherwise("conflicting")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_OUTCOMES = """o AS (SELECT l_returnflag AS strategy, l_suppkey % 50 AS sym, l_orderkey * 10 + l_linenumber AS id, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS since, year(l_shipdate) AS fold, l_linestatus AS variant, l_discount - l_tax AS net FROM lineitem),
e AS (SELECT *, exp(sum(ln(greatest(0.01, 1 + net))) OVER (PARTITION BY strategy ORDER BY since, id, net ROWS UNBOUNDED PRECEDING)) AS eq FROM o), k AS (SELECT *, greatest(1.0, max(eq) OVER (PARTITION BY strategy ORDER BY since, id, net ROWS UNBOUNDED PRECEDING)) AS peak FROM e),
cs AS (SELECT strategy, sym, sum(net) AS s FROM o GROUP BY 1, 2), cd AS (SELECT strategy, since // 86400 AS day, sum(net) AS s FROM o GROUP BY 1, 2), cf AS (SELECT strategy, fold, avg(net) AS m FROM o GROUP BY 1, 2), base AS (SELECT avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS r FROM o),
cv AS (SELECT strategy, variant, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) / (SELECT r FROM base) AS l FROM o GROUP BY 1, 2),
s AS (SELECT strategy, count(*) AS trades, count(DISTINCT sym) AS coins, count(DISTINCT since // 86400) AS days, count(DISTINCT date_trunc('month', make_timestamp(since * 1000000))) AS months, avg(net) AS net_mean, max(1 - eq / peak) AS max_drawdown,
 sum(CASE WHEN net > 0 THEN net END) / -sum(CASE WHEN net < 0 THEN net END) AS profit_factor, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) / (SELECT r FROM base) AS matched_lift FROM k GROUP BY 1),
t AS (SELECT s.*, (SELECT coalesce(max(s2.s) / sum(s2.s), 1) FROM cs s2 WHERE s2.strategy = s.strategy AND s2.s > 0) AS top_sym_share, (SELECT coalesce(max(d.s) / sum(d.s), 1) FROM cd d WHERE d.strategy = s.strategy AND d.s > 0) AS top_day_share,
 (SELECT count(*) FROM cf WHERE cf.strategy = s.strategy AND m > 0) AS positive_folds, (SELECT min(l) FROM cv WHERE cv.strategy = s.strategy) AS least FROM s)"""


@query(f"""WITH {_OUTCOMES}, g AS (SELECT *, 'shadow' AS stage, [CASE WHEN trades < 100 THEN 'trades' END, CASE WHEN coins < 40 THEN 'coins' END, CASE WHEN days < 20 THEN 'days' END, CASE WHEN net_mean <= 0 THEN 'expectancy' END, CASE WHEN matched_lift < 1.3 THEN 'matched-lift' END, CASE WHEN least <= 1.15 THEN 'sensitivity' END] AS r FROM t
UNION ALL SELECT *, 'paper', [CASE WHEN trades < 200 THEN 'trades' END, CASE WHEN coins < 60 THEN 'coins' END, CASE WHEN days < 60 THEN 'days' END, CASE WHEN net_mean <= 0 THEN 'expectancy' END, CASE WHEN months < 3 THEN 'months' END, CASE WHEN positive_folds < 3 THEN 'walk-forward' END, 'bootstrap',
 CASE WHEN net_mean - 0.003 <= 0 THEN 'stress' END, CASE WHEN max_drawdown > 0.1 THEN 'drawdown' END, CASE WHEN top_sym_share > 0.1 THEN 'one-coin' END, CASE WHEN top_day_share > 0.2 THEN 'one-day' END] FROM t)
SELECT strategy, stage, trades, coins, days, months, round(net_mean, 6) AS net_mean, round(max_drawdown, 5) AS max_drawdown, round(profit_factor, 5) AS profit_factor, round(top_sym_share, 6) AS top_sym_share, round(top_day_share, 6) AS top_day_share,
array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS reasons, len(list_filter(r, lambda x: x IS NOT NULL)) = 0 AS passed FROM g""")
def strategy_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as outcomes of three strategies, held against the rules of both stages; their bootstrap is unknown, which fails it."""
    line, net = table(spark, sf_dir, "lineitem"), F.col("l_discount") - F.col("l_tax")
    rows = line.select(F.col("l_returnflag").alias("strategy"), (F.col("l_suppkey") % 50).alias("sym"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), epoch(F.col("l_shipdate")).alias("since"), F.year("l_shipdate").alias("fold"), F.col("l_linestatus").alias("variant"), net.alias("net"))
    won = F.avg((F.col("net") > 0).cast("double"))
    folds = rows.groupBy("strategy", "fold").agg(F.avg("net").alias("m")).groupBy("strategy").agg(F.count_if(F.col("m") > 0).alias("positive_folds"))
    lifts = rows.groupBy("strategy", "variant").agg(won.alias("w")).groupBy("strategy").agg(F.min("w").alias("least"))
    found = R.strategy_summary(rows, ["strategy"]).join(folds, "strategy").join(lifts, "strategy").join(rows.groupBy("strategy").agg(won.alias("w")), "strategy")
    every = Window.partitionBy(F.lit(0))  # one row a strategy
    found = found.withColumn("base", F.sum(F.col("w") * F.col("trades")).over(every) / F.sum("trades").over(every))
    found = found.withColumns({"matched_lift": F.col("w") / F.col("base"), "least_sensitivity": F.col("least") / F.col("base"), "stress_mean": F.col("net_mean") - 0.003, "bootstrap_lower": F.lit(None).cast("double")})
    both = [R.promotion(found, R.stage_rules(stage)).withColumn("stage", F.lit(stage)) for stage in ("shadow", "paper")]
    out = both[0].unionByName(both[1]).withColumn("reasons", F.array_join("reasons", ","))
    shown = {"net_mean": 6, "max_drawdown": 5, "profit_factor": 5, "top_sym_share": 6, "top_day_share": 6}
    return rounded(out.select("strategy", "stage", "trades", "coins", "days", "months", *shown, "reasons", "passed"), shown)
