"""Queries of the evaluation operators, on quality labels and a coarse score by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import outcome
from ..operators import evaluation as ev
from ..sources.store import table
from . import views as v
from .registry import query

P = v.PREDICTIONS


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {P}, c AS (SELECT split, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp,
count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM p GROUP BY split),
r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS a, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS b, (tp + fp + fn + tn)::DOUBLE AS n FROM c)
SELECT split, tp, fp, fn, tn, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) AS f1,
round((tp + tn) / n, 6) AS accuracy, round((tp + fp) / n, 6) AS flagged FROM r""")
def ev01_binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.confusion(v.predictions(spark, d), ["split"], 0.5), "precision", "recall", "f1", "accuracy", "flagged")


@query(f"""WITH {P}, s AS (SELECT split, score, sum(label) AS h, count(*) AS n FROM p GROUP BY 1, 2),
w AS (SELECT split, h, sum(h) OVER x AS tp, sum(n) OVER x AS seen, sum(h) OVER (PARTITION BY split) AS pos FROM s WINDOW x AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT split, round(coalesce(sum(h::DOUBLE / nullif(pos, 0) * tp / seen), 0), 6) AS ap FROM w GROUP BY split""")
def ev02_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.average_precision(v.predictions(spark, d), ["split"]), "ap")


@query(f"""WITH {P} SELECT s.split, auc FROM (SELECT DISTINCT split FROM p) s LEFT JOIN (
SELECT a.split, round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc
FROM p a JOIN p b ON a.split = b.split AND a.label = 1 AND b.label = 0 GROUP BY a.split) x ON x.split = s.split""")
def ev03_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.roc_auc(v.predictions(spark, d), ["split"]), "auc")


@query(f"""WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, sample_id) AS k, count(*) OVER (PARTITION BY split) AS n FROM p)
SELECT split, round(avg(label), 6) AS precision_at FROM r WHERE k <= ceil(n * 0.2) GROUP BY split""")
def ev04_precision_at_20(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.precision_at(v.predictions(spark, d), ["split"], "sample_id"), "precision_at")


def threshold_sql(order: str) -> str:
    return f"""WITH {P}, t AS (SELECT DISTINCT split, score AS t FROM p),
c AS (SELECT t.split, t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t) AS k, count(*) FILTER (label = 1) AS pos FROM t JOIN p ON p.split = t.split GROUP BY 1, 2),
f AS (SELECT split, t, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (k + pos) ELSE 0 END, 12) AS f1, round(tp::DOUBLE / k, 12) AS pr FROM c)
SELECT split, t AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY f1 DESC, {order}) AS k FROM f) WHERE k = 1"""


@query(threshold_sql("t"))
def ev05_threshold_lowest(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.best_threshold(v.predictions(spark, d), ["split"], "lowest"), "f1")


@query(threshold_sql("pr DESC, t DESC"))
def ev05_threshold_precise(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.best_threshold(v.predictions(spark, d), ["split"], "precise"), "f1")


@query(threshold_sql("abs(t - 0.5), t"))
def ev05_threshold_middle(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.best_threshold(v.predictions(spark, d), ["split"], "middle"), "f1")


@query("""WITH a AS (SELECT DISTINCT l_returnflag AS relation, l_orderkey AS x, l_suppkey AS y FROM lineitem WHERE l_quantity >= 30),
b AS (SELECT DISTINCT l_returnflag AS relation, l_orderkey AS x, l_suppkey AS y FROM lineitem WHERE l_discount >= 0.05),
j AS (SELECT coalesce(a.relation, b.relation) AS relation, a.x AS ax, b.x AS bx FROM a FULL JOIN b ON a.relation = b.relation AND a.x = b.x AND a.y = b.y),
c AS (SELECT relation, count(*) FILTER (ax IS NOT NULL AND bx IS NOT NULL) AS tp, count(*) FILTER (bx IS NULL) AS fp, count(*) FILTER (ax IS NULL) AS fn FROM j GROUP BY ROLLUP (relation))
SELECT relation, tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def ev10_set_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("relation"), F.col("l_orderkey").alias("x"), F.col("l_suppkey").alias("y"), "l_quantity", "l_discount")
    return r6(ev.set_scores(rows.where("l_quantity >= 30"), rows.where("l_discount >= 0.05"), ["x", "y"], ["relation"]), "precision", "recall", "f1")


POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]


@query(f"""WITH {P}, b AS (SELECT r, label, ('0x' || substr(md5('boot:' || r || ':' || sample_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM p, range(0, 1000) x(r)),
w AS (SELECT r, label, {" + ".join(f"(u >= {c})::INT" for c in POISSON)} AS w FROM b)
SELECT CAST(r AS INTEGER) AS resample, round(sum(w * label)::DOUBLE / sum(w), 6) AS mean FROM w GROUP BY r""")
def ev07_bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.bootstrap_means(v.predictions(spark, d), "sample_id", "label", 1000), "mean")


@query(f"""WITH {P}, q AS (SELECT quantile_cont(score, [0.025, 0.975]) AS q FROM p) SELECT round(q[1], 6) AS low, round(q[2], 6) AS high FROM q""")
def sx13_middle_95(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.middle_95(v.predictions(spark, d), "score"), "low", "high")


@query("""WITH t AS (SELECT event_type AS name, round(least(1, avg(value) / 1000 + 0.001), 9) AS p FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM t)
SELECT name, p, round(least(1, max(p * (m - i + 1)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM r""")
def wn13_holm(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.least(F.lit(1.0), F.avg("value") / 1000 + 0.001), 9).alias("p"))
    return ev.holm(tests, "p", "name").withColumn("adjusted", F.round("adjusted", 9))


@query("""WITH d AS (SELECT round(l_quantity) - round(l_discount * 500) AS d FROM lineitem), c AS (SELECT d, (SELECT 0) AS z FROM d WHERE d <> 0),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM c)
SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic FROM r""")
def ev16_signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.round("l_quantity").alias("a"), F.round(F.col("l_discount") * 500).alias("b"))
    return ev.signed_ranks(rows, "a", "b")


RATED = """v AS (SELECT user_id AS unit, event_type AS rater, least(5, 1 + floor(avg(value) / 10))::INT AS v FROM events GROUP BY 1, 2)"""


def rated(spark: SparkSession, d: str) -> DataFrame:
    v_ = F.least(F.lit(5), 1 + F.floor(F.avg("value") / 10)).cast("int")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("rater")).agg(v_.alias("v"))


@query(f"""WITH {RATED}, c AS (SELECT unit FROM v GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT rater) FROM v)), x AS (SELECT v.* FROM v JOIN c USING (unit)),
r AS (SELECT unit, rater, rank() OVER (PARTITION BY unit ORDER BY v) + (count(*) OVER (PARTITION BY unit, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY unit, v) AS t FROM x),
k AS (SELECT rater, sum(r) AS s, count(*) AS n FROM r GROUP BY 1), a AS (SELECT count(*) AS k, max(n) AS n, sum(s * s) AS rr FROM k), t AS (SELECT sum(t * t - 1) AS ties FROM r)
SELECT n, k, round((12.0::DOUBLE / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - ties::DOUBLE / (n * k * (k * k - 1))), 6) AS chi2 FROM a, t""")
def ev16_friedman(spark: SparkSession, d: str) -> DataFrame:
    rows = rated(spark, d)
    full = rows.groupBy("unit").count().join(rows.agg(F.countDistinct("rater").alias("k")), F.col("count") == F.col("k")).select("unit")
    return r6(ev.friedman(rows.join(full, "unit", "left_semi"), "unit", "rater", "v"), "chi2")


@query(f"""WITH {RATED}, m AS (SELECT *, count(*) OVER (PARTITION BY unit) AS m FROM v), x AS (SELECT * FROM m WHERE m > 1), g AS (SELECT v, count(*) AS n FROM x GROUP BY 1),
h AS (SELECT v, n, sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - n / 2.0::DOUBLE AS mid FROM g),
o AS (SELECT sum((a.mid - b.mid) ** 2 / (p.m - 1)) AS o FROM x p JOIN x q ON p.unit = q.unit AND p.rater <> q.rater JOIN h a ON a.v = p.v JOIN h b ON b.v = q.v),
e AS (SELECT sum(a.n * b.n * (a.mid - b.mid) ** 2) AS e FROM h a, h b) SELECT round(1 - ((SELECT sum(n) FROM g) - 1) * o / e, 6) AS alpha FROM o, e""")
def ev17_krippendorff(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.krippendorff_ordinal(rated(spark, d), "unit", "v"), "alpha")


@query(f"""WITH {P}, y AS (SELECT label, score AS a, 1 - abs(score - 0.6) AS b FROM p), g AS (SELECT x / 20.0::DOUBLE AS alpha FROM range(0, 21) t(x)),
l AS (SELECT alpha, label, round(1 / (1 + exp(-(alpha * ln(greatest(least(a, 1 - 1e-6), 1e-6) / (1 - greatest(least(a, 1 - 1e-6), 1e-6))) + (1 - alpha) * ln(greatest(least(b, 1 - 1e-6), 1e-6) / (1 - greatest(least(b, 1 - 1e-6), 1e-6)))))), 9) AS s FROM y, g),
c AS (SELECT alpha, s, sum(label) AS h, count(*) AS n FROM l GROUP BY 1, 2),
w AS (SELECT alpha, h, sum(h) OVER x AS tp, sum(n) OVER x AS seen, sum(h) OVER (PARTITION BY alpha) AS pos FROM c WINDOW x AS (PARTITION BY alpha ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT alpha, round(sum(h::DOUBLE / pos * tp / seen), 6) AS ap FROM w GROUP BY alpha""")
def ml06_late_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = v.predictions(spark, d).select("label", F.col("score").alias("a"), (1 - F.abs(F.col("score") - 0.6)).alias("b"))
    return r6(ev.late_fusion(rows, "a", "b", [i / 20 for i in range(21)]), "ap")


@query(f"""WITH {P} SELECT CASE WHEN score >= 0.5 AND label = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM p GROUP BY 1""")
def sf24_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return v.predictions(spark, d).groupBy(outcome(F.col("label"), F.col("score") >= 0.5).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {P} SELECT split, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS spread FROM p GROUP BY split""")
def ag10_descriptive(spark: SparkSession, d: str) -> DataFrame:
    s = v.predictions(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"), F.stddev_pop("score").alias("spread"))
    return r6(s, "mean", "median", "spread")


@query("""WITH u AS (SELECT l_orderkey, 'quantity' AS item, l_quantity AS x FROM lineitem UNION ALL SELECT l_orderkey, 'discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_tax FROM lineitem)
SELECT item, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM u GROUP BY item""")
def ev19_unpivot_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = rows.unpivot(["l_orderkey"], ["quantity", "discount", "tax"], "item", "x")
    return r6(long.groupBy("item").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median")), "mean", "median")
