"""Queries of the joins, set operations, aggregations and scalar functions that larger operators are built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import evaluation as ev
from ..operators import features as fe
from ..operators import graph as g
from ..operators import labels as lb
from ..operators import models as ml
from ..operators import relations as rl
from ..operators import retrieval as rt
from ..operators import splits as sp
from ..operators import temporal as t
from ..sources import store
from ..sources.store import table
from . import views as v
from .registry import query

E, P = v.EDGES, v.PREDICTIONS


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in columns})


# Joins


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def jn01_lookup(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return rl.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), rich, "o_custkey", ["c_mktsegment"])


@query("SELECT p_partkey, coalesce(n, 0) AS n, coalesce(flag, '-') AS flag FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_returnflag) AS flag FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1) ON l_partkey = p_partkey")
def jn02_with_default(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").where("l_discount >= 0.1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    return rl.with_default(table(spark, d, "part").select("p_partkey"), n, "p_partkey", {"n": 0, "flag": "-"})


@query("""SELECT CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS state, count(*) AS n
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON a.k = b.k GROUP BY 1""")
def jn03_reconciled(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return rl.counts(rl.reconciled(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), "k"), ["state"])


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax >= 0.08)")
def jn04_among(spark: SparkSession, d: str) -> DataFrame:
    return rl.among(table(spark, d, "part").select("p_partkey", "p_size"), table(spark, d, "lineitem").where("l_tax >= 0.08").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax >= 0.08)")
def jn05_absent(spark: SparkSession, d: str) -> DataFrame:
    return rl.absent(table(spark, d, "part").select("p_partkey", "p_size"), table(spark, d, "lineitem").where("l_tax >= 0.08").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query("SELECT n_nationkey, seed FROM nation, (VALUES (1), (2), (3), (4), (5)) t(seed)")
def jn12_grid(spark: SparkSession, d: str) -> DataFrame:
    return rl.grid(table(spark, d, "nation").select("n_nationkey"), "seed", [1, 2, 3, 4, 5])


# Aggregations


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def ag01_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return rl.counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS some, bool_and(l_quantity > 10) AS every FROM lineitem GROUP BY 1")
def ag03_any_all(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("x"))
    return lines.select("l_orderkey", rl.any_of(F.col("x"), lambda x: x["l_returnflag"] == "R").alias("some"), rl.every_of(F.col("x"), lambda x: x["l_quantity"] > 10).alias("every"))


@query("SELECT o_custkey, round(ln(1 + count(DISTINCT lower(o_orderpriority))), 6) AS authors, round(ln(1 + count(DISTINCT o_orderkey)), 6) AS commits FROM orders GROUP BY 1")
def ag05_distinct_logs(spark: SparkSession, d: str) -> DataFrame:
    return r6(rl.distinct_logs(table(spark, d, "orders"), "o_custkey", {"authors": F.lower("o_orderpriority"), "commits": F.col("o_orderkey")}), "authors", "commits")


@query("""WITH s AS (SELECT l_orderkey AS sample, l_returnflag AS tag, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2) SELECT sample, tag, round(w / sum(w) OVER (PARTITION BY sample), 9) AS weight FROM s""")
def ag06_normalised_weights(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("tag"), F.col("l_quantity").alias("weight"))
    return rt.normalised_weights(tags).withColumn("weight", F.round("weight", 9))


@query("SELECT round(avg(ln(1 + n_chars)), 6) AS n_chars_mean, round(greatest(stddev_pop(ln(1 + n_chars)), 1e-6), 6) AS n_chars_std FROM documents WHERE lang = 'en'")
def ag07_train_scaler(spark: SparkSession, d: str) -> DataFrame:
    return r6(fe.fit_scaler(table(spark, d, "documents").where("lang = 'en'"), ["n_chars"]), "n_chars_mean", "n_chars_std")


@query("""WITH f AS (SELECT DISTINCT l_returnflag AS kind, l_orderkey AS x, l_suppkey AS y FROM lineitem WHERE l_quantity > 25), g AS (SELECT DISTINCT l_returnflag AS kind, l_orderkey AS x, l_suppkey AS y FROM lineitem WHERE l_discount > 0.04),
n AS (SELECT (SELECT count(*) FROM (FROM f INTERSECT FROM g)) AS tp, (SELECT count(*) FROM (FROM f EXCEPT FROM g)) AS fp, (SELECT count(*) FROM (FROM g EXCEPT FROM f)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM n""")
def ag09_micro_average(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.set_scores(*found_and_gold(spark, d), ["x", "y"], ["kind"]).where("kind IS NULL").select("tp", "fp", "fn", "precision", "recall"), "precision", "recall")


def found_and_gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("x"), F.col("l_suppkey").alias("y"), "l_quantity", "l_discount")
    return lines.where("l_quantity > 25"), lines.where("l_discount > 0.04")


@query("""WITH n AS (SELECT l_returnflag AS kind, l_orderkey AS x, l_suppkey AS y, bool_or(l_quantity > 25) AS f, bool_or(l_discount > 0.04) AS g FROM lineitem GROUP BY 1, 2, 3)
SELECT kind, count(*) FILTER (f AND g) AS tp, count(*) FILTER (f AND NOT g) AS fp, count(*) FILTER (g AND NOT f) AS fn FROM n GROUP BY ROLLUP (kind)""")
def ev11_benchmark_by_category(spark: SparkSession, d: str) -> DataFrame:
    return ev.set_scores(*found_and_gold(spark, d), ["x", "y"], ["kind"]).select("kind", "tp", "fp", "fn")


@query("""WITH n AS (SELECT l_returnflag AS kind, l_orderkey AS x, l_suppkey AS y, bool_or(l_quantity > 25) AS f, bool_or(l_discount > 0.04) AS g FROM lineitem GROUP BY 1, 2, 3)
SELECT kind, round(2 * count(*) FILTER (f AND g) / (count(*) FILTER (f) + count(*) FILTER (g))::DOUBLE, 6) AS f1 FROM n GROUP BY ROLLUP (kind)""")
def ev12_gold_agreement(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.set_scores(*found_and_gold(spark, d), ["x", "y"], ["kind"]).select("kind", "f1"), "f1")


@query(f"WITH {P}, s AS (SELECT sample_id, seed, round(score * seed / 5.0::DOUBLE, 4) AS score FROM p, (VALUES (1), (2), (3), (4), (5)) t(seed)) SELECT seed, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, count(*) AS runs FROM s GROUP BY 1")
def ag11_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    return r6(rl.over_seeds(seeded(spark, d), ["seed"], "score"), "mean", "deviation")


@query(f"WITH {P}, s AS (SELECT sample_id, seed, round(score * seed / 5.0::DOUBLE, 4) AS score FROM p, (VALUES (1), (2), (3), (4), (5)) t(seed)) SELECT sample_id, round(avg(score), 6) AS mean FROM s GROUP BY 1")
def ag12_mean_score(spark: SparkSession, d: str) -> DataFrame:
    return r6(rl.over_seeds(seeded(spark, d), ["sample_id"], "score").select("sample_id", "mean"), "mean")


def seeded(spark: SparkSession, d: str) -> DataFrame:
    return rl.grid(v.predictions(spark, d).select("sample_id", "score"), "seed", [1, 2, 3, 4, 5]).withColumn("score", F.round(F.col("score") * F.col("seed") / 5.0, 4))


# Windows


@query("""WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), x AS (SELECT l_suppkey AS event_id, count(*) AS blocks, any_value(s_nationkey) AS merged_at FROM b JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT event_id, blocks, row_number() OVER (ORDER BY blocks DESC, merged_at, event_id) AS place FROM x""")
def wn09_blocker_places(spark: SparkSession, d: str) -> DataFrame:
    blocked = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_set("l_suppkey").alias("unresolved"))
    return lb.placed(lb.blocker_queue(blocked, table(spark, d, "supplier").select(F.col("s_suppkey").alias("event_id"), F.col("s_nationkey").alias("merged_at")))).select("event_id", "blocks", "place")


@query(f"""WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, sample_id) AS k, count(*) OVER (PARTITION BY split) AS n FROM p) SELECT split, round(avg(label), 6) AS precision_at FROM r WHERE k <= ceil(n * 0.2) GROUP BY 1""")
def wn10_top_share(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.precision_at(v.predictions(spark, d), ["split"], "sample_id", 0.2), "precision_at")


@query(f"""WITH {P}, s AS (SELECT split, score, sum(label) AS hits, count(*) AS n FROM p GROUP BY 1, 2) SELECT split, score, hits, n, sum(hits) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def wn11_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return ev.by_score(v.predictions(spark, d), ["split"]).select("split", "score", "hits", "n", "tp", "seen")


# Set operations


@query(f"WITH {E} SELECT src, dst FROM edges WHERE relation = 'NO' UNION SELECT src, dst FROM edges WHERE relation = 'RF'")
def so01_union(spark: SparkSession, d: str) -> DataFrame:
    e = v.edges(spark, d)
    return rl.united(*[e.where(F.col("relation") == x).select("src", "dst") for x in ("NO", "RF")])


@query(f"WITH {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)} SELECT *, 'added' AS side FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT FROM b)")
def so02_differences(spark: SparkSession, d: str) -> DataFrame:
    return rl.differences(v.plain(spark, d, 1995), v.plain(spark, d, 1996), ["src", "dst"])


@query(f"WITH {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)} FROM a INTERSECT FROM b")
def so03_kept(spark: SparkSession, d: str) -> DataFrame:
    return rl.kept(v.plain(spark, d, 1995), v.plain(spark, d, 1996), ["src", "dst"])


SIDES = "n AS (SELECT l_orderkey AS k, l_suppkey AS x, bool_or(l_returnflag = 'R') AS a, bool_or(l_quantity > 25) AS b FROM lineitem GROUP BY 1, 2), s AS (SELECT k, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (a AND b) AS c FROM n WHERE a OR b GROUP BY 1)"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("x"), "l_returnflag", "l_quantity")
    return lines.where("l_returnflag = 'R'"), lines.where("l_quantity > 25")


@query(f"WITH {SIDES} SELECT k, round(1 - c / (na + nb - c)::DOUBLE, 6) AS distance FROM s")
def so04_jaccard_distance(spark: SparkSession, d: str) -> DataFrame:
    return r6(rl.overlap(*sides(spark, d), ["k"], "x").select("k", "distance"), "distance")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT p_partkey FROM part WHERE p_size > 5")
def so05_outside(spark: SparkSession, d: str) -> DataFrame:
    return rl.outside(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")), table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("k")), ["k"])


@query(f"WITH {SIDES} SELECT k, round(2 * c / (na + nb)::DOUBLE, 6) AS agreement FROM s")
def so07_specific_agreement(spark: SparkSession, d: str) -> DataFrame:
    return r6(rl.overlap(*sides(spark, d), ["k"], "x").select("k", "agreement"), "agreement")


# Splits


@query("""WITH s AS (SELECT o_custkey AS repo, count(DISTINCT CASE WHEN o_orderdate < TIMESTAMP '1997-06-01' THEN 'train' ELSE 'test' END) AS splits FROM orders GROUP BY 1) SELECT repo, splits FROM s WHERE splits > 1""")
def sp03_holdout_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.when(F.col("o_orderdate") < F.lit("1997-06-01").cast("timestamp_ntz"), "train").otherwise("test").alias("split"))
    return sp.crossing_groups(rows, "repo")


@query("SELECT c_custkey, sha256('9:' || c_custkey) AS place FROM customer")
def sp05_hash_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", sp.hash_order(F.col("c_custkey"), "9").alias("place"))


CUTS = """r AS (SELECT o_custkey AS repo, o_orderdate AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
k AS (SELECT repo, max(CASE WHEN p = least(n - 2, greatest(1, ceil(n * 0.55))) THEN t END) AS a, max(CASE WHEN p = least(n - 1, greatest(2, ceil(n * 0.75))) THEN t END) AS b FROM r WHERE n >= 3 GROUP BY repo)"""


@query(f"""WITH {CUTS}, s AS (SELECT repo, CASE WHEN o_orderdate + INTERVAL 6 MONTH <= a THEN 'train' WHEN o_orderdate >= a AND o_orderdate + INTERVAL 6 MONTH <= b THEN 'validation' WHEN o_orderdate >= b THEN 'test' ELSE 'purged' END AS split FROM orders JOIN k ON repo = o_custkey)
SELECT split, count(*) AS n, count(DISTINCT repo) AS repos FROM s GROUP BY 1""")
def sp06_cutoff_report(spark: SparkSession, d: str) -> DataFrame:
    return by_repository(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


@query(f"""WITH {CUTS} SELECT o_orderkey AS sample, CASE WHEN o_orderdate + INTERVAL 6 MONTH <= a THEN 'train' WHEN o_orderdate >= a AND o_orderdate + INTERVAL 6 MONTH <= b THEN 'validation' WHEN o_orderdate >= b THEN 'test' ELSE 'purged' END AS split
FROM orders JOIN k ON repo = o_custkey""")
def sp02_split_by_repository(spark: SparkSession, d: str) -> DataFrame:
    return by_repository(spark, d).select("sample", "split")


def by_repository(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("repo"), at.alias("at"), (at + F.make_ym_interval(F.lit(0), F.lit(6))).alias("horizon_end"))
    return sp.split_by_repository(rows, t.chronological_cutoffs(rows, "repo", "at", (0.55, 0.75)), "repo")


@query("""WITH s AS (SELECT doc_id, 'train' AS split FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id % 3 = 2 OR doc_id % 30 = 0), x AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
SELECT coalesce(x.doc_id, l.doc_id) AS doc_id, CASE WHEN x.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unknown' ELSE 'twice' END AS problem FROM x FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 > 0 UNION SELECT -1) l ON x.doc_id = l.doc_id WHERE x.doc_id IS NULL OR l.doc_id IS NULL OR n > 1""")
def sp09_split_cover(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    splits = docs.where(k % 3 < 2).withColumn("split", F.lit("train")).union(docs.where((k % 3 == 2) | (k % 30 == 0)).withColumn("split", F.lit("test")))
    known = docs.where(k % 7 > 0).union(spark.range(1).select((F.col("id") - 1).alias("doc_id")))
    return sp.cover_problems(splits, known, "doc_id")


@query("""WITH h AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM labels JOIN documents USING (doc_id) WHERE lang = 'en') SELECT doc_id, quality FROM h WHERE r <= 20""")
def sp10_balanced_test_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id").select("doc_id", "quality")
    return sp.balanced_pick(rows, "quality", "doc_id", "42", 20)


# Scalar functions


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS head, split_part(p_type, ' ', -1) AS tail, CASE WHEN starts_with(p_type, 'STANDARD ') THEN substr(p_type, 10) ELSE p_type END AS cut FROM part")
def sf01_text_parts(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", c.before_first(x, " ").alias("head"), c.after_last(x, " ").alias("tail"), c.without_ends(F.concat(F.lit("  "), x, F.lit("!")), "STANDARD ", "!").alias("cut"))


@query(r"SELECT c_custkey, nullif(regexp_extract(c_name, '0+([1-9]\d*)', 1), '') AS digits, regexp_full_match(c_name, 'Customer#\d+') AS whole FROM customer")
def sf02_matches(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", c.first_match(x, r"0+([1-9]\d*)", 1).alias("digits"), c.is_whole(x, r"Customer#\d+").alias("whole"))


@query("SELECT n_nationkey, 'a-' || n_name || ' - b' AS plain FROM nation")
def sf04_plain_dashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", c.plain_dashes(F.concat(F.lit("a–"), F.col("n_name"), F.lit(" —  b"))).alias("plain"))


@query("SELECT c_custkey, format('{:.2f}', c_acctbal) AS fixed, CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END || CAST(CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS DECIMAL(15, 1)) AS VARCHAR) AS signed FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 3 = 0")
def sf05_number_formats(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", c.fixed(x, 2).alias("fixed"), c.signed_cents(x, 1).alias("signed"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 2 HOUR END AS moment FROM orders")
def sf06_aware_times(spark: SparkSession, d: str) -> DataFrame:
    iso, k = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).otherwise(iso)
    return table(spark, d, "orders").select("o_orderkey", c.aware_timestamp(text).cast("timestamp_ntz").alias("moment"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS recent, (date_trunc('month', o_orderdate) - INTERVAL 6 MONTH)::TIMESTAMP AS past FROM orders")
def sf08_snapshot_moments(spark: SparkSession, d: str) -> DataFrame:
    recent, past = c.snapshot_moments(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", recent.cast("timestamp_ntz").alias("recent"), past.cast("timestamp_ntz").alias("past"))


@query("SELECT o_orderkey, round(epoch(o_orderdate) / 86400 / 365.25::DOUBLE, 6) AS years FROM orders")
def sf09_epoch_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(c.epoch_years(F.col("o_orderdate")), 6).alias("years"))


@query("SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal / 1000.0::DOUBLE))), 9) AS p FROM customer")
def sf11_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(c.sigmoid(F.col("c_acctbal") / 1000.0), 9).alias("p"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_tax + 0.1) AS p, (l_discount + 0.2) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q)), 9) AS kl FROM x")
def sf12_binary_divergence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(c.binary_kl(F.col("l_tax") + 0.1, F.col("l_discount") + 0.2), 9).alias("kl"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 + p_size % 3 > 0 THEN round(p_size % 3 / (p_size % 5 + p_size % 3)::DOUBLE, 9) ELSE 0 END AS instability FROM part")
def sf13_instability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(c.instability(F.col("p_size") % 5, F.col("p_size") % 3), 9).alias("instability"))


@query("SELECT p_partkey, round_even(p_size / 4.0::DOUBLE, 1) AS x, round_even(p_size / 2.0::DOUBLE, 0) AS y FROM part")
def sf14_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", c.half_even(F.col("p_size") / 4.0, 1).alias("x"), c.half_even(F.col("p_size") / 2.0, 0).alias("y"))


def diffs(spark: SparkSession, d: str) -> DataFrame:
    """A unified diff of two files for each part: so many added and removed lines as its size leaves over 5 and 3."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    body = F.concat(F.lit("@@ -1,3 +1,4 @@ def f\n same\n"), F.repeat(F.lit("+new = 1\n"), s % 5), F.repeat(F.lit("-old = 2\n"), s % 3))
    head = lambda n: F.concat(F.lit("diff --git a/x"), k, F.lit(f"{n}.py b/x"), k, F.lit(f"{n}.py\n--- a/x"), k, F.lit(f"{n}.py\n+++ b/x"), k, F.lit(f"{n}.py\n"))
    return table(spark, d, "part").select("p_partkey", "p_size", F.concat(head("a"), body, F.lit("@@ -20 +21,2 @@\n+more\n"), head("b"), body).alias("diff"))


@query("SELECT p_partkey, round(ln(1 + 2 * (p_size % 5) + 1), 6) AS added, round(ln(1 + 2 * (p_size % 3)), 6) AS removed, round(ln(3), 6) AS files, round(ln(4), 6) AS hunks FROM part")
def sf18_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    s = fe.change_sizes(F.col("diff"))
    return diffs(spark, d).select("p_partkey", *[F.round(s[n], 6).alias(n) for n in ("added", "removed", "files", "hunks")])


@query("""SELECT p_partkey, 'x' || p_partkey || f || '.py' AS file, h AS hunk, CASE WHEN h = 0 THEN 1 ELSE 21 END AS first, CASE WHEN h = 0 THEN 4 ELSE 22 END AS last, CASE WHEN h = 0 THEN 1 + p_size % 5 + p_size % 3 ELSE 1 END AS lines
FROM part, (VALUES ('a', 0), ('a', 1), ('b', 0)) t(f, h)""")
def sf19_hunks(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import diffs as df

    return df.hunks(diffs(spark, d), "p_partkey", "diff").select("p_partkey", "file", "hunk", "first", "last", F.size("lines").alias("lines"))


@query("""SELECT p_partkey, 'x' || p_partkey || f || '.py' AS file, '<keep>same' || repeat(chr(10) || '<add>new = 1', (p_size % 5)::BIGINT) || repeat(chr(10) || '<del>old = 2', (p_size % 3)::BIGINT) || CASE f WHEN 'a' THEN chr(10) || '<add>more' ELSE '' END AS marked
FROM part, (VALUES ('a'), ('b')) t(f)""")
def sf20_marked_files(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import diffs as df

    return df.marked(df.by_file(diffs(spark, d), "p_partkey", "diff"), "body").select("p_partkey", "file", "marked")


@query("""SELECT p_partkey, string_agg(x, chr(10) ORDER BY f) AS prepared FROM (SELECT p_partkey, f, 'x' || p_partkey || f || '.py' || chr(10) || '<keep>same' || repeat(chr(10) || '<add>new = 1', (p_size % 5)::BIGINT) || repeat(chr(10) || '<del>old = 2', (p_size % 3)::BIGINT)
|| CASE f WHEN 'a' THEN chr(10) || '<add>more' ELSE '' END AS x FROM part, (VALUES ('a'), ('b')) t(f) WHERE NOT (f = 'b' AND p_partkey % 2 = 0)) GROUP BY 1""")
def sx44_prepared_diff(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import diffs as df

    wanted = df.by_file(diffs(spark, d), "p_partkey", "diff").select("p_partkey", "file").where("NOT (file LIKE '%b.py' AND p_partkey % 2 = 0)")
    return df.prepared(diffs(spark, d), wanted, "p_partkey", "diff")


@query("SELECT p_partkey, 1 + p_size % 5 + p_size % 3 + CASE f WHEN 'a' THEN 1 ELSE 0 END AS lines, 'x' || p_partkey || f || '.py' AS file FROM part, (VALUES ('a'), ('b')) t(f)")
def sx45_converted_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import diffs as df

    out = df.marked(df.by_file(diffs(spark, d), "p_partkey", "diff"), "body")
    return out.select("p_partkey", "file", F.size(F.split("marked", "\n")).alias("lines"))


VALUES = "[p_size::DOUBLE, p_retailprice::DOUBLE, 0.12345]"


@query(f"SELECT p_partkey, list_aggregate(list_transform({VALUES}, lambda x: abs(x - round(p_retailprice, 1)) <= 0.05 + 1e-12), 'bool_or') AS near, p_size IN (7, 0) OR abs(p_retailprice - 7) <= 0.5 AS seven FROM part")
def sf22_supported_numbers(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), F.lit(0.12345))
    near = rt.supported(F.format_string("%.1f", F.round("p_retailprice", 1)), values)
    return table(spark, d, "part").select("p_partkey", near.alias("near"), rt.supported(F.lit("7"), values).alias("seven"))


@query("SELECT p_partkey, p_size <= 10 AS small, true AS shortened, true AS percent FROM part")
def sf23_card_numbers(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("p_size") / 64.0
    ok = lambda n: rt.card_supported(n, F.array(share))
    return table(spark, d, "part").select("p_partkey", ok(F.concat(F.col("p_size").cast("string"))).alias("small"), ok(F.format_string("%.3f", F.bround(share, 3))).alias("shortened"), ok(F.concat(F.format_string("%.1f", F.bround(share * 100, 1)), F.lit("%"))).alias("percent"))


# Filters


@query("SELECT o_orderkey, coalesce(n >= 3, false) AS passes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_tax > 0.02 GROUP BY 1) ON l_orderkey = o_orderkey")
def fl02_impact(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").where("l_tax > 0.02").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", c.passes_impact(F.col("n")).alias("passes"))


@query(r"SELECT p_partkey, regexp_matches(lower(p_type), '(^|[^\w-])steel($|[^\w-])') AS has FROM part")
def fl05_phrase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", c.has_phrase(F.col("p_type"), "Steel").alias("has"))


PATHS = "CASE p_partkey % 6 WHEN 0 THEN 'src/a' || p_partkey || '.py' WHEN 1 THEN 'tests/a.py' WHEN 2 THEN 'docs/conf.py' WHEN 3 THEN 'src\\b' || p_partkey || '.py' WHEN 4 THEN 'src/test_x.py' ELSE 'setup.py' END"


def some_paths(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("src/a"), name, F.lit(".py"))).when(k == 1, "tests/a.py").when(k == 2, "docs/conf.py").when(k == 3, F.concat(F.lit(" src\\b"), name, F.lit(".py"))).when(k == 4, "src/test_x.py").otherwise("setup.py")
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 3) AS analysed FROM part")
def fl11_analysed_paths(spark: SparkSession, d: str) -> DataFrame:
    return some_paths(spark, d).select("p_partkey", c.is_production_python(F.col("path")).alias("analysed"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 1, 3, 4) AS included FROM part")
def fl12_included_files(spark: SparkSession, d: str) -> DataFrame:
    return some_paths(spark, d).select("p_partkey", c.is_production_python(F.col("path"), tests=True).alias("included"))


@query(f"SELECT DISTINCT replace({PATHS}, chr(92), '/') AS path FROM part")
def fl17_normal_paths(spark: SparkSession, d: str) -> DataFrame:
    return some_paths(spark, d).select(c.normal_path(F.col("path")).alias("path")).where("path <> ''").distinct()


@query(f"""WITH {P} SELECT sample_id, row_number() OVER (ORDER BY label = 1 DESC, split = 'en' DESC, score DESC, sample_id) AS place FROM p""")
def fl15_listing_order(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d)
    return lb.listed(p, F.col("label") == 1, F.col("split") == "en", "score", "sample_id").select("sample_id", "place")


@query(f"WITH {P} SELECT sample_id FROM p WHERE split IN ('en', 'de') AND score >= 0.5 AND contains(lower('PR ' || sample_id), 'r 1')")
def fl18_view_filter(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d).withColumn("title", F.concat(F.lit("PR "), F.col("sample_id").cast("string")))
    return lb.view_filter(p, splits=["en", "de"], flagged=True, title_part="R 1", threshold=0.5).select("sample_id")


# Stores and small graph helpers


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def sx55_last_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return store.last_per_key(rows, ["user_id"], "at").select("user_id", "event_id")


@query(f"WITH {E}, {v.sql_edges('e', 1995)} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def sx09_undirected(spark: SparkSession, d: str) -> DataFrame:
    return g.undirected(v.plain(spark, d, 1995))


@query("""SELECT s_nationkey AS graph, round(coalesce(avg(s_suppkey % 7) FILTER (s_suppkey % 2 = 0), 0), 6) AS a, round(coalesce(avg(s_suppkey % 11) FILTER (s_suppkey % 2 = 0), 0), 6) AS b FROM supplier GROUP BY 1""")
def sx10_pooled(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("graph"), F.array((k % 7).cast("double"), (k % 11).cast("double")).alias("x"))
    return ml.pooled(nodes, nodes.where("id % 2 = 0").select("id"), "graph").select("graph", F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


@query("""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x NOT IN ('""" + "', '".join(rt.STOPWORDS) + """'))) AS n FROM documents""")
def sx27_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(rt.tokens(F.col("text"), True)).cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1""")
def sx28_index(spark: SparkSession, d: str) -> DataFrame:
    return rt.index(table(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("SELECT p_partkey, regexp_matches(p_type, '(^|[^A-Za-z0-9_])(BRASS|SMALL PLATED)($|[^A-Za-z0-9_])') AS has FROM part")
def sx29_has_phrase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (rt.has_words(F.col("p_type"), "brass") | rt.has_words(F.col("p_type"), "small plated")).alias("has"))


@query("SELECT s_suppkey, 'own_proj_' || s_suppkey AS key, 'pkg.m' || s_suppkey AS module, 'v' || s_suppkey AS version FROM supplier")
def sx40_sanitised_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select("s_suppkey", c.project_key(F.concat(F.lit("own/proj#"), k)).alias("key"), c.dotted_module(F.concat(F.lit("pkg/m"), k, F.lit("/__init__.py"))).alias("module"), c.manifest_version(F.concat(F.lit("data/pr_v"), k)).alias("version"))


@query("SELECT s_suppkey, 'v' || s_suppkey AS version FROM supplier")
def sx14_manifest_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", c.manifest_version(F.concat(F.lit("data/pr_v"), F.col("s_suppkey").cast("string"))).alias("version"))


@query("SELECT s_suppkey, 'pkg.m' || s_suppkey || '.a' AS module FROM supplier")
def sx43_module_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", c.dotted_module(F.concat(F.lit("pkg/m"), F.col("s_suppkey").cast("string"), F.lit("/a.py"))).alias("module"))
