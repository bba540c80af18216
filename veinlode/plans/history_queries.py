"""Queries of the temporal joins, windows, splits, labels and store operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import splits as sp
from ..operators import temporal as t
from ..sources import store
from ..sources.store import table
from .registry import query


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT o_custkey, o_orderdate, o_orderkey AS sha FROM orders WHERE o_orderstatus = 'F')
SELECT s.o_orderkey, s.o_custkey, s.o_orderdate, (SELECT arg_max(sha, (c.o_orderdate, sha)) FROM c WHERE c.o_custkey = s.o_custkey AND c.o_orderdate <= s.o_orderdate) AS sha FROM s""")
def jn06_as_of_commit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    left = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate")
    right = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("sha"))
    return t.as_of(left, right, "o_custkey", "o_orderdate", ["sha"])


SETS = "s AS (SELECT DISTINCT o_custkey AS repo, o_orderkey AS pr, o_orderdate AS at, l_suppkey AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def change_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("pr"), F.col("o_orderdate").alias("at"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr"), F.col("l_suppkey").alias("file"))
    return o.join(files, "pr").select("repo", "pr", "at", "file").distinct()


@query(f"""WITH {SETS} SELECT a.pr AS earlier, b.pr AS later, count(*) AS shared FROM s a JOIN s b ON a.repo = b.repo AND a.file = b.file
AND b.at > a.at AND b.at <= a.at + INTERVAL 6 MONTH GROUP BY a.pr, b.pr""")
def jn07_interval_pairs(spark: SparkSession, d: str) -> DataFrame:
    return t.overlapping_pairs(change_sets(spark, d), "repo", "file", "pr", "at", 6)


@query("""SELECT a.l_orderkey AS k, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND a.l_quantity::INT <= b.l_quantity::INT + 7 AND b.l_quantity::INT <= a.l_quantity::INT + 5""")
def jn09_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    left = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("x"), F.col("q").alias("start"), (F.col("q") + 5).alias("end"))
    right = lines.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("y"), F.col("q").alias("low"), (F.col("q") + 7).alias("high"))
    return t.interval_overlap(left, right, "k", 8).select("k", "x", "y")


FOLLOW = """s AS (SELECT o_orderkey AS sample_id, o_custkey AS repo, o_orderdate AS at FROM orders WHERE o_orderpriority <> '1-URGENT'),
e AS (SELECT o_orderkey AS event_id, o_custkey AS repo, o_orderdate AS event_at, o_orderstatus = 'F' AS reviewed FROM orders WHERE o_orderpriority = '1-URGENT'),
near AS (SELECT sample_id, event_id, event_at, reviewed FROM s JOIN e ON e.repo = s.repo AND event_at > s.at AND event_at <= s.at + INTERVAL 6 MONTH)"""


def follow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    samples = o.where(~urgent).select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("at"))
    events = o.where(urgent).select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("event_at"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    return samples, events


@query(f"WITH {FOLLOW} SELECT sample_id, event_id, event_at FROM near")
def jn08_all_in_horizon(spark: SparkSession, d: str) -> DataFrame:
    return lb.within_horizon(*follow(spark, d), "repo", 6)


@query(f"""WITH {FOLLOW}, f AS (SELECT sample_id, arg_min(event_id, (event_at, event_id)) AS event_id FROM near GROUP BY 1), n AS (SELECT o_custkey AS repo, max(o_orderdate) AS seen FROM orders GROUP BY 1)
SELECT s.sample_id, CASE WHEN seen < s.at + INTERVAL 6 MONTH THEN 'censored' ELSE 'labelled' END AS status, CASE WHEN seen >= s.at + INTERVAL 6 MONTH THEN event_id END AS event_id,
CASE WHEN seen >= s.at + INTERVAL 6 MONTH THEN (event_id IS NOT NULL)::INT END AS label FROM s JOIN n USING (repo) LEFT JOIN f USING (sample_id)""")
def jn10_first_in_horizon(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.max("o_orderdate").alias("observed_until"))
    return lb.first_outcome(*follow(spark, d), ends, "repo", 6)


STATUS = "CASE (sample_id + event_id) % 7 WHEN 0 THEN 'unverified_boundary' WHEN 1 THEN 'unrelated_lineage' WHEN 2 THEN 'uncertain_file_identity' ELSE 'verified' END"


@query(f"""WITH {FOLLOW}, t AS (SELECT DISTINCT l_orderkey AS id, l_suppkey % 20 AS path FROM lineitem WHERE l_orderkey % 17 > 0),
m AS (SELECT sample_id, event_id, {STATUS} AS status, EXISTS (SELECT 1 FROM t a JOIN t b ON a.path = b.path WHERE a.id = sample_id AND b.id = event_id) AS common FROM near WHERE (sample_id + event_id) % 5 > 0),
w AS (SELECT o_custkey AS repo, min(o_orderdate) + INTERVAL 1 MONTH AS a, max(o_orderdate) AS b FROM orders WHERE o_custkey % 19 > 0 GROUP BY 1),
x AS (SELECT s.sample_id, CASE WHEN s.sample_id % 11 = 0 THEN 'excluded_non_substantive_change' WHEN s.sample_id NOT IN (SELECT id FROM t) THEN 'excluded_no_python_files' WHEN w.a IS NULL THEN 'unverified_coverage'
      WHEN s.at < w.a OR s.at + INTERVAL 6 MONTH > w.b THEN 'censored' WHEN s.sample_id % 13 = 0 THEN 'incomplete_sample_history' WHEN s.sample_id NOT IN (SELECT sample_id FROM m) THEN 'unverified_lineage' END AS early
      FROM s LEFT JOIN w USING (repo)),
r AS (SELECT near.sample_id, min((event_at, near.event_id)) FILTER (reviewed AND status = 'verified' AND common) AS event, list_sort(list(near.event_id) FILTER (NOT reviewed AND status = 'verified' AND common)) AS open,
      list_sort(list(near.event_id) FILTER (coalesce(status NOT IN ('verified', 'unrelated_lineage'), true))) AS unknown FROM near LEFT JOIN m USING (sample_id, event_id) GROUP BY 1),
y AS (SELECT x.sample_id, coalesce(early, CASE WHEN event IS NOT NULL THEN 'labelled' WHEN len(open) > 0 THEN 'unreviewed_outcome' WHEN len(unknown) > 0 THEN 'unverified_followup_history' ELSE 'labelled' END) AS status, event, open, unknown FROM x LEFT JOIN r USING (sample_id))
SELECT sample_id, status, CASE WHEN status = 'labelled' THEN (event IS NOT NULL)::INT END AS label, CASE WHEN status = 'labelled' THEN struct_extract_at(event, 2) END AS event_id,
array_to_string(CASE status WHEN 'unreviewed_outcome' THEN open WHEN 'unverified_followup_history' THEN unknown END, ',') AS unresolved FROM y""")
def lb03_outcome_labels(spark: SparkSession, d: str) -> DataFrame:
    samples, events = follow(spark, d)
    k = F.col("sample_id")
    files = table(spark, d, "lineitem").where("l_orderkey % 17 > 0").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 20).cast("string").alias("path")).distinct()
    of = lambda name: files.withColumnRenamed("id", name)
    pairs = lb.within_horizon(samples, events, "repo", 6).select("sample_id", "event_id").where("(sample_id + event_id) % 5 > 0")
    common = pairs.join(of("sample_id"), "sample_id").join(of("event_id"), ["event_id", "path"]).groupBy("sample_id", "event_id").agg(F.collect_set("path").alias("matched"))
    n = (k + F.col("event_id")) % 7
    status = F.when(n == 0, "unverified_boundary").when(n == 1, "unrelated_lineage").when(n == 2, "uncertain_file_identity").otherwise("verified")
    matches = pairs.join(common, ["sample_id", "event_id"], "left").withColumn("status", status)
    windows = table(spark, d, "orders").where("o_custkey % 19 > 0").groupBy(F.col("o_custkey").alias("repo")).agg((F.min("o_orderdate") + F.expr("INTERVAL '1' MONTH")).alias("observed_from"), F.max("o_orderdate").alias("observed_until"))
    out = lb.future_outcomes(samples, events, of("sample_id"), windows, matches, samples.where(k % 11 == 0), samples.where(k % 13 == 0), 6)
    listed = F.when(F.col("unresolved").isNotNull(), F.concat_ws(",", F.transform("unresolved", lambda x: x.cast("string"))))
    return out.withColumn("event_id", F.when(F.col("status") == "labelled", F.col("event_id"))).withColumn("unresolved", listed)


LINES = "c AS (SELECT o_orderkey AS sha, o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place, o_orderpriority, o_orderstatus FROM orders)"


@query(f"""WITH {LINES}, p AS (SELECT a.sha AS sample_id, b.sha AS event_id FROM c a JOIN c b ON a.o_orderpriority = '1-URGENT' AND ((a.line = b.line AND b.place IN (a.place + 1, a.place + 3)) OR (b.line = a.line + 1 AND b.place = 1))),
f AS (SELECT DISTINCT l_orderkey AS id, l_suppkey % 20 AS path FROM lineitem), m AS (SELECT DISTINCT c.line, c.place, l_suppkey % 20 AS path FROM lineitem JOIN c ON sha = l_orderkey WHERE l_returnflag = 'R' AND l_discount >= 0.09),
x AS (SELECT sample_id, event_id, s.line AS sl, e.line AS el, s.place AS sp, e.place - 1 AS bp, s.o_orderstatus <> 'P' AND e.o_orderstatus <> 'P' AS ok FROM p JOIN c s ON s.sha = sample_id JOIN c e ON e.sha = event_id),
y AS (SELECT *, CASE WHEN sl <> el THEN 'unrelated_lineage' WHEN NOT ok THEN 'unverified_boundary' WHEN EXISTS (SELECT 1 FROM f JOIN m ON m.path = f.path WHERE f.id = sample_id AND m.line = sl AND m.place > sp AND m.place <= bp) THEN 'uncertain_file_identity' ELSE 'verified' END AS status FROM x)
SELECT sample_id, event_id, status, CASE WHEN status = 'verified' THEN (SELECT count(*) FROM f a JOIN f b ON a.path = b.path WHERE a.id = sample_id AND b.id = event_id) END AS matched FROM y""")
def jn13_lineage_match(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    from ..operators import lineage

    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    place = (F.row_number().over(own) - 1).cast("long")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("line"), place.alias("place"), F.lag("o_orderkey").over(own).alias("before_sha"), "o_orderpriority", "o_orderstatus")
    o = store.cut(o)
    at = o.where("o_orderpriority = '1-URGENT'").select(F.col("sha").alias("sample_id"), F.explode(F.array(F.struct("line", (F.col("place") + 1).alias("place")), F.struct("line", (F.col("place") + 3).alias("place")), F.struct((F.col("line") + 1).alias("line"), F.lit(1).cast("long").alias("place")))).alias("x"))
    pairs = at.select("sample_id", "x.line", "x.place").join(o.select(F.col("sha").alias("event_id"), "line", "place"), ["line", "place"]).select("sample_id", "event_id")
    records = o.select(F.col("sha").alias("pr_id"), "sha", "before_sha", (F.col("o_orderstatus") != "P").alias("verified"))
    commits = o.select("sha", "line", "place", F.create_map("line", "place").alias("reaches"))
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 20).cast("string").alias("path"), "l_returnflag", "l_discount")
    files = lambda name: lines.select(F.col("l_orderkey").alias(name), "path").distinct()
    moved = lines.where("l_returnflag = 'R' AND l_discount >= 0.09").join(o.select(F.col("sha").alias("l_orderkey"), "line", "place"), "l_orderkey").select("line", "place", "path").distinct()
    found = lineage.match(pairs, commits, records, files("sample_id"), files("event_id"), moved)
    return found.select("sample_id", "event_id", "status", F.when(F.col("matched").isNotNull(), F.size("matched")).cast("long").alias("matched"))


@query("""WITH m AS (SELECT l_orderkey AS sample_id, l_linenumber AS event_id, CASE l_returnflag WHEN 'R' THEN 'verified' WHEN 'A' THEN 'unrelated_lineage' ELSE 'unknown_lineage' END AS status, l_quantity > 25 AS files FROM lineitem)
SELECT sample_id, count(*) FILTER (status = 'verified' AND files) AS matches, count(*) FILTER (status <> 'unknown_lineage') AS settled FROM m GROUP BY 1""")
def lb07_lineage_states(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.lineage import is_match, is_settled

    status = F.when(F.col("l_returnflag") == "R", "verified").when(F.col("l_returnflag") == "A", "unrelated_lineage").otherwise("unknown_lineage")
    files = F.when(F.col("l_quantity") > 25, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count_if(is_match(status, files)).alias("matches"), F.count_if(is_settled(status)).alias("settled"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(source), '(^|[^\\w-])src[13]($|[^\\w-])')""".replace("\\\\", "\\"))
def lb04_title_events(spark: SparkSession, d: str) -> DataFrame:
    return lb.title_events(table(spark, d, "documents"), ["src1", "src3"], "source").select("doc_id")


@query("""SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 182 DAY PRECEDING AND CURRENT ROW) AS recent FROM lineitem""")
def st07_trailing_activity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"), "l_orderkey", "l_linenumber")
    return t.trailing_count(rows, "l_partkey", "l_shipdate", 182, "recent").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


HOT = """WITH f AS (SELECT l_partkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
h AS (SELECT l_partkey, count(*) AS changes FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01' - INTERVAL 182 DAY AND l_shipdate <= TIMESTAMP '1998-01-01' GROUP BY 1),
x AS (SELECT o.l_orderkey AS sample, coalesce(h.changes, 0) AS c, p_size AS w FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) o
      LEFT JOIN h ON h.l_partkey = o.l_partkey JOIN part ON p_partkey = o.l_partkey)
"""


@query(HOT + "SELECT sample, sum(c)::BIGINT AS total, max(c) AS most, max(c * w) AS hottest FROM x GROUP BY sample")
def fe11_hotspot(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.features import hotspots

    return hotspots(*hot_inputs(spark, d)).select("sample", "total", "most", "hottest")


@query(HOT + "SELECT sample, round(sum(c) * avg(w), 6) AS hotspot FROM x GROUP BY sample")
def fe12_hotspot_mean(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.features import hotspots

    return hotspots(*hot_inputs(spark, d)).select("sample", F.round("mean_product", 6).alias("hotspot"))


def hot_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem")
    recent = lines.where("l_shipdate > TIMESTAMP_NTZ '1998-01-01' - INTERVAL 182 DAYS AND l_shipdate <= TIMESTAMP_NTZ '1998-01-01'")
    files = lines.select(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("file")).distinct()
    size = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("complexity"))
    return files, recent.groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").alias("changes")), size


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def wn05_top_k(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return t.ranked_cut(o, ["o_custkey"], [F.desc(F.abs(F.col("o_totalprice") - 150000)), F.asc("o_orderkey")], 3)


@query("SELECT o_orderpriority, quantile_disc(o_totalprice, 0.9) AS cutoff FROM orders GROUP BY o_orderpriority")
def wn08_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return t.nearest_rank(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.9)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR p IN (SELECT floor(i * n / 4.0)::BIGINT FROM range(0, 4) x(i))""")
def wn03_evenly(spark: SparkSession, d: str) -> DataFrame:
    return t.evenly(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_custkey AS repo, o_orderdate AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT repo, max(CASE WHEN p = least(n - 2, greatest(1, ceil(n * 0.55))) THEN r.at END) AS train_cutoff, max(CASE WHEN p = least(n - 1, greatest(2, ceil(n * 0.75))) THEN r.at END) AS validation_cutoff
FROM r WHERE n >= 3 GROUP BY repo""")
def wn02_chronological_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("at"))
    return t.chronological_cutoffs(rows, "repo", "at", (0.55, 0.75))


SPLIT = """CASE WHEN o_orderdate + INTERVAL 6 MONTH <= TIMESTAMP '1997-06-01' THEN 'train'
WHEN o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate + INTERVAL 6 MONTH <= TIMESTAMP '1999-06-01' THEN 'validation'
WHEN o_orderdate >= TIMESTAMP '1999-06-01' THEN 'test' ELSE 'purged' END"""


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    cut = lambda s: F.lit(s).cast("timestamp_ntz")
    split = sp.temporal_split(at, at + F.make_ym_interval(F.lit(0), F.lit(6)), cut("1997-06-01"), cut("1999-06-01"))
    label = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", split.alias("split"), label.alias("label"))


@query(f"SELECT o_orderkey, {SPLIT} AS split FROM orders")
def sp01_temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(spark, d).select("o_orderkey", "split")


@query(f"""SELECT split, o_orderpriority AS repo, count(*) FILTER (l = 0) AS safe, count(*) FILTER (l = 1) AS risky, count(*) AS total
FROM (SELECT *, {SPLIT} AS split, (o_orderstatus = 'F')::INT AS l FROM orders) GROUP BY ROLLUP (split, o_orderpriority)""")
def ag08_cohort_report(spark: SparkSession, d: str) -> DataFrame:
    return sp.cohort_report(split_rows(spark, d).withColumnRenamed("o_orderpriority", "repo"), "split", "repo", "label")


@query(f"SELECT o_custkey, count(DISTINCT split) AS splits FROM (SELECT *, {SPLIT} AS split FROM orders) WHERE split <> 'purged' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def so06_crossing_groups(spark: SparkSession, d: str) -> DataFrame:
    return sp.crossing_groups(split_rows(spark, d), "o_custkey")


@query("""WITH s AS (SELECT o_custkey AS repo, count(*) AS n, sha256('7:' || o_custkey) AS h FROM orders GROUP BY 1), a AS (SELECT sum(n) AS a FROM s),
x AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < a * 0.2 AS t FROM s, a),
y AS (SELECT *, coalesce(sum(CASE WHEN NOT t THEN n END) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM x)
SELECT repo, n, CASE WHEN t THEN 'test' WHEN r < a * 0.2 THEN 'validation' ELSE 'train' END AS split FROM y""")
def wn04_greedy_split(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("n"))
    return sp.greedy_split(sizes, "repo", "n", "7", 0.2, 0.2)


@query("""WITH s AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY sha256('3:' || doc_id), doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY quality) AS p FROM labels)
SELECT doc_id, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'validation' ELSE 'test' END AS split FROM s""")
def sp07_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.stratified_split(table(spark, d, "labels"), "doc_id", "quality", "3", (0.6, 0.2)).select("doc_id", "split")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def sx12_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return sp.duplicates(table(spark, d, "lineitem"), "l_suppkey")


@query("""WITH a AS (SELECT doc_id, n_chars % 7 AS x FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN quality = 0 THEN -1 ELSE n_chars % 7 END AS x FROM documents JOIN labels USING (doc_id))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing_left' WHEN b.doc_id IS NULL THEN 'missing_right' ELSE 'x' END AS problem
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.x IS DISTINCT FROM b.x""")
def sp08_alignment(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    x = F.col("n_chars") % 7
    a = docs.where("doc_id % 10 <> 3").select("doc_id", x.alias("x"))
    b = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 0, -1).otherwise(x).alias("x"))
    return sp.alignment_problems(a, b, "doc_id", ["x"])


@query("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS batch FROM documents")
def wn12_batches(spark: SparkSession, d: str) -> DataFrame:
    return sp.batches(table(spark, d, "documents"), "lang", "doc_id", 50).select("doc_id", "lang", "batch")


@query("""SELECT l_partkey, max_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY l_partkey""")
def wn01_newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    return store.last_per_key(rows, ["l_partkey"], "at").select("l_partkey", "l_orderkey")


@query("""WITH l AS (SELECT user_id, event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(name || '=' || round(value, 3), ',' ORDER BY name) AS merged FROM l GROUP BY 1""")
def io18_merge_sparse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("name"), "value", F.struct("ts", "event_id").alias("at"))
    merged = store.merge_sparse(rows, "user_id", "name", "value", "at")
    pairs = F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 3).cast("string")))
    return merged.select("user_id", F.concat_ws(",", pairs).alias("merged"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 90)")
def io20_resume(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    done = e.where("event_type = 'click' AND value > 90").select("user_id")
    return store.new_rows(done, e.where("event_type = 'purchase'").select("user_id"), "user_id")


@query("""SELECT coalesce(o.k, l.k) AS k, CASE WHEN o.k IS NULL THEN 'not_collected' ELSE 'not_stored' END AS problem
FROM (SELECT DISTINCT o_custkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT user_id AS k FROM events) l ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL""")
def lb05_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return lb.coverage_violations(a, table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query("""WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT l_suppkey, count(*) AS blocks FROM b GROUP BY 1)
SELECT l_suppkey AS event_id, blocks, s_nationkey AS merged_at FROM c JOIN supplier ON s_suppkey = l_suppkey""")
def lb10_blocker_queue(spark: SparkSession, d: str) -> DataFrame:
    blocked = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_set("l_suppkey").alias("unresolved"))
    return lb.blocker_queue(blocked, table(spark, d, "supplier").select(F.col("s_suppkey").alias("event_id"), F.col("s_nationkey").alias("merged_at")))


@query("""SELECT o_custkey, max(o_orderdate) AS observed_until, min(o_orderdate) AS first_seen, count(DISTINCT lower(o_orderpriority)) AS authors, ln(1 + count(DISTINCT o_orderkey)) AS log_commits FROM orders GROUP BY 1""")
def ag04_observation_ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("observed_until"), F.min("o_orderdate").alias("first_seen"),
        F.countDistinct(F.lower("o_orderpriority")).alias("authors"), F.log1p(F.countDistinct("o_orderkey")).alias("log_commits"),
    )


@query("""SELECT o_orderkey, CASE WHEN n IS NULL OR n = 0 THEN 'missing' WHEN n >= 5 THEN 'merge' WHEN n = 1 THEN 'single' WHEN o_orderstatus = 'F' THEN 'ambiguous' ELSE 'ambiguous' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def lb08_boundary_status(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    parents = F.when(F.col("n") >= 5, 2).when(F.col("n").isNotNull(), 1)
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", lb.boundary_status(parents, F.lit(False), F.col("n")).alias("status"))


@query("""SELECT split_part(p_type, ' ', 1) AS folder, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1""")
def io25_folder_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.translate("p_type", " ", "/").alias("path"), "p_retailprice")
    return store.totals_by_folder(rows, "path", "p_retailprice").withColumn("total", F.round("total", 2))
