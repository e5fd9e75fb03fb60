"""Queries over the experiment ledger: runs, seeds, best rows, rates, edit logs.

An event is a ledger row: its user is the run, the user modulo 5 the seed, its type the kind, its value the metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates, windows
from ..registry import query
from ..tables import table


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 5).alias("seed"), (F.col("user_id") / 5).cast("long").alias("config"), F.element_at(F.array(*map(F.lit, ("APT", "DEH", "ROW"))), (F.col("event_id") % 3 + 1).cast("int")).alias("house"))


LEDGER = "ledger AS (SELECT event_id, ts, user_id, event_type, value, user_id % 5 AS seed, user_id // 5 AS config, (['APT', 'DEH', 'ROW'])[event_id % 3 + 1] AS house FROM events)"


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_id, user_id, event_type, value FROM r WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    """The last ledger row of each run and kind."""
    return windows.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("""WITH v AS (SELECT DISTINCT user_id, CAST(floor(value * 10) AS BIGINT) AS v FROM events), j AS (
  SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY user_id ORDER BY v) > 25 THEN 1 ELSE 0 END AS jump FROM v),
i AS (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY v) AS island FROM j)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n_values, min(v) AS low, max(v) AS high, CAST(sum(v) AS BIGINT) AS total FROM i GROUP BY 1, 2""")
def gap_clustering(spark, sf_dir):
    """Runs of distinct values whose gaps stay within a tolerance."""
    v = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") * 10).cast("long").alias("v"))
    return windows.islands(v, ["user_id"], "v", 25)


@query(f"WITH {LEDGER} SELECT config, event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(value) AS n, count(DISTINCT seed) AS seeds FROM ledger WHERE event_type <> 'error' GROUP BY 1, 2")
def seed_aggregate(spark, sf_dir):
    """Mean and sample deviation over seeds; retired kinds are left out, one value has deviation 0."""
    mean, std, n = aggregates.mean_std(F.col("value"))
    rows = ledger(spark, sf_dir).where("event_type <> 'error'")
    return rows.groupBy("config", "event_type").agg(F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"), n.alias("n"), F.countDistinct("seed").alias("seeds"))


@query(f"""WITH {LEDGER}, m AS (SELECT config, house, avg(value) AS v FROM ledger WHERE event_type = 'view' GROUP BY 1, 2)
SELECT config, round(max(v) FILTER (WHERE house = 'APT'), 6) AS apt, round(max(v) FILTER (WHERE house = 'DEH'), 6) AS deh, round(max(v) FILTER (WHERE house = 'ROW'), 6) AS row_house, round(avg(v), 6) AS macro, round(sum(v) / 3, 6) AS macro_zero FROM m GROUP BY 1""")
def dwelling_macro(spark, sf_dir):
    """Means by house type, their mean over those present, and the mean that counts an absent one as 0."""
    m = ledger(spark, sf_dir).where("event_type = 'view'").groupBy("config", "house").agg(F.avg("value").alias("v"))
    of = lambda h: F.round(F.max(F.when(F.col("house") == h, F.col("v"))), 6)
    return m.groupBy("config").agg(of("APT").alias("apt"), of("DEH").alias("deh"), of("ROW").alias("row_house"), F.round(F.avg("v"), 6).alias("macro"), F.round(F.sum("v") / 3, 6).alias("macro_zero"))


@query("SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn FROM events WHERE value IS NOT NULL) WHERE rn = 1")
def best_run(spark, sf_dir):
    """The run with the least metric per kind, the smaller id on a tie."""
    return aggregates.arg_min(table(spark, sf_dir, "events").where("value is not null"), ["event_type"], ["value", "event_id"], ["event_id", "user_id", "value"])


@query(f"""WITH {LEDGER}, t AS (SELECT user_id, min(value) AS l1, event_id_div AS diversity FROM (SELECT *, (user_id % 97) / 97.0 AS event_id_div FROM ledger) GROUP BY user_id, event_id_div),
g AS (SELECT user_id % 10 AS sweep, *, diversity >= 0.5 AS ok, max(CASE WHEN diversity >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 10) AS any_ok FROM t)
SELECT sweep, user_id FROM (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY l1, user_id) AS rn FROM g WHERE ok OR any_ok = 0) WHERE rn = 1""")
def guarded_argmin(spark, sf_dir):
    """The least metric among rows that pass a guard, or among all if none does."""
    t = ledger(spark, sf_dir).groupBy("user_id").agg(F.min("value").alias("l1")).withColumn("sweep", F.col("user_id") % 10)
    ok = (F.col("user_id") % 97) / F.lit(97.0) >= 0.5
    key = F.struct("l1", "user_id")
    got = t.groupBy("sweep").agg(F.coalesce(F.min(F.when(ok, key)), F.min(key)).alias("m"))
    return got.select("sweep", "m.user_id")


RUN_ID = "'gen-v' || (user_id % 3) || '-' || (['baseline', 'neural', 'setTransformer'])[user_id % 3 + 1] || CASE WHEN user_id % 2 = 0 THEN '-noPretrain' ELSE '' END || '-seed' || (user_id % 5)"


@query(rf"""WITH r AS (SELECT DISTINCT {RUN_ID} AS run_id FROM events)
SELECT run_id, regexp_replace(run_id, '-seed\d+', '') AS config, regexp_extract(run_id, 'gen-(v\d+)', 1) AS version, string_split(run_id, '-')[3] AS generator, NOT contains(run_id, 'noPretrain') AS pretrained, CAST(regexp_extract(run_id, 'seed(\d+)', 1) AS INTEGER) AS seed FROM r""")
def run_id_parse(spark, sf_dir):
    """Run names built from their parts and parsed back into axes."""
    u = F.col("user_id")
    run = F.concat_ws("-", F.lit("gen"), F.concat(F.lit("v"), (u % 3).cast("string")), F.element_at(F.array(*map(F.lit, ("baseline", "neural", "setTransformer"))), (u % 3 + 1).cast("int")), F.when(u % 2 == 0, F.lit("noPretrain")), F.concat(F.lit("seed"), (u % 5).cast("string")))
    r = table(spark, sf_dir, "events").select(run.alias("run_id")).distinct()
    x = F.col("run_id")
    return r.select(x, S.config_key(x).alias("config"), F.regexp_extract(x, r"gen-(v\d+)", 1).alias("version"), F.get(F.split(x, "-"), F.lit(2)).alias("generator"), (~F.contains(x, F.lit("noPretrain"))).alias("pretrained"), F.regexp_extract(x, r"seed(\d+)", 1).cast("int").alias("seed"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value >= 60) AS k FROM events GROUP BY 1), w AS (SELECT *, k / n AS p, 1.96 AS z FROM s)
SELECT user_id, n, k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * CAST(n AS DOUBLE) * n))) / (1 + z * z / n)), 9) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * CAST(n AS DOUBLE) * n))) / (1 + z * z / n)), 9) AS high,
 CASE WHEN p > 0 AND p < 1 THEN CAST(ceil(ln(0.05) / ln(1 - p)) AS BIGINT) END AS draws FROM w""")
def wilson_acceptance(spark, sf_dir):
    """Acceptance with its Wilson interval and the draws that succeed with 95 %."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 60).alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return s.select("user_id", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), S.draws_for(F.col("k") / F.col("n")).alias("draws"))


@query("""WITH j AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'o' WHEN event_type = 'error' THEN 'x' END AS verdict, event_type = 'signup' AS missing FROM events)
SELECT user_id, count(verdict) AS judged, CASE WHEN count(verdict) > 0 THEN count(*) FILTER (WHERE verdict = 'o') / count(verdict) END AS precision,
 CASE WHEN count(*) FILTER (WHERE verdict = 'o') + count(*) FILTER (WHERE missing) > 0 THEN count(*) FILTER (WHERE verdict = 'o') / (count(*) FILTER (WHERE verdict = 'o') + count(*) FILTER (WHERE missing)) END AS recall FROM j GROUP BY 1""")
def gate_precision_recall(spark, sf_dir):
    """Precision over judged rows, recall with the missed ones; null without a denominator."""
    t = F.col("event_type")
    verdict = F.when(t.isin("view", "click"), "o").when(t == "error", "x")
    j = table(spark, sf_dir, "events").select("user_id", verdict.alias("verdict"), (t == "signup").cast("int").alias("missing"))
    precision, recall = aggregates.rates(F.coalesce(F.col("verdict") == "o", F.lit(False)), F.col("verdict").isNotNull(), F.col("missing"))
    return j.groupBy("user_id").agg(F.count("verdict").alias("judged"), precision.alias("precision"), recall.alias("recall"))


@query("SELECT conv_id, turn, role, count(*) FILTER (WHERE role = 'assistant') OVER w AS answered, CAST(sum(length(text)) OVER w AS BIGINT) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)")
def agreement_ladder(spark, sf_dir):
    """Running totals over ordered turns."""
    c = table(spark, sf_dir, "conversations").withColumns({"one": (F.col("role") == "assistant").cast("long"), "len": F.length("text").cast("long")})
    order = ["turn", "role", "text"]
    return aggregates.running_total(aggregates.running_total(c, ["conv_id"], order, "one", "answered"), ["conv_id"], order, "len", "chars").select("conv_id", "turn", "role", "answered", "chars")


@query("SELECT user_id % 7 AS actor, event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS plans FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def ledger_summary(spark, sf_dir):
    """Edits by actor and kind, and how many plans they touch; kinds outside the vocabulary are rejected."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.groupBy((F.col("user_id") % 7).alias("actor"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("plans"))


@query(f"WITH {LEDGER}, h AS (SELECT house, seed % 2 = 0 AS on_, avg(value) AS v, stddev_pop(value) AS s FROM ledger GROUP BY 1, 2) SELECT a.house, round(a.v, 6) AS on_mean, round(a.s, 6) AS on_std, round(b.v, 6) AS off_mean, round(b.s, 6) AS off_std, round(a.v - b.v, 6) AS delta FROM h a JOIN h b ON a.house = b.house AND a.on_ AND NOT b.on_")
def typed_effect(spark, sf_dir):
    """Mean and population deviation with a condition on and off, by house type."""
    r, on = ledger(spark, sf_dir), F.col("seed") % 2 == 0
    v = lambda c: F.when(c, F.col("value"))
    g = r.groupBy("house").agg(F.avg(v(on)).alias("a"), F.stddev_pop(v(on)).alias("sa"), F.avg(v(~on)).alias("b"), F.stddev_pop(v(~on)).alias("sb"))
    return g.select("house", F.round("a", 6).alias("on_mean"), F.round("sa", 6).alias("on_std"), F.round("b", 6).alias("off_mean"), F.round("sb", 6).alias("off_std"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query("WITH k AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'a' END AS sa, CASE WHEN event_type = 'error' THEN 'b' END AS sb FROM events), u AS (SELECT user_id, max(sa) AS a, max(sb) AS b FROM k GROUP BY 1) SELECT count(a) AS only_a_or_both, count(b) AS only_b_or_both, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both_signals, count(*) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL) AS either FROM u")
def contamination_union(spark, sf_dir):
    """Two signals per plan, and how many have each, both, or either."""
    t = F.col("event_type")
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(t == "purchase").alias("a"), F.bool_or(t == "error").alias("b"))
    return u.agg(F.count_if("a").alias("only_a_or_both"), F.count_if("b").alias("only_b_or_both"), F.count_if(F.col("a") & F.col("b")).alias("both_signals"), F.count_if(F.col("a") | F.col("b")).alias("either"))
