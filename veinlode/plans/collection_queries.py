"""Queries of collected records: stores, cursors, blobs, commit pairs, changed paths and prepared samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collection as co
from ..sources import store
from ..sources.store import table
from ..streaming import streams as st
from .registry import query
from .stream_queries import CLOSED, events, naive


def shared(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    store.cut(spark.range(0).toDF("x"))  # sets the folder where none is
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("repo"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("title"))


RECORDS = "SELECT o_orderkey::VARCHAR AS id, o_custkey AS repo, o_orderstatus AS state, o_orderpriority AS title FROM orders"


@query(RECORDS)
def io01_read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    rows, path = records(spark, d), shared(spark, "io01")
    rows.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("",)], "value string")).write.text(path)  # one line is blank
    return store.read_jsonl(spark, path, rows.schema)


@query(RECORDS)
def io02_append_twice(spark: SparkSession, d: str) -> DataFrame:
    rows, path = records(spark, d), shared(spark, "io02")
    store.append_jsonl(spark, path, rows.where("state = 'F'"), "id")
    store.append_jsonl(spark, path, rows, "id")
    store.append_jsonl(spark, path, rows, "id")
    return store.read_jsonl(spark, path, rows.schema)


@query(f"SELECT * FROM ({RECORDS}) WHERE state <> 'F'")
def io03_replace(spark: SparkSession, d: str) -> DataFrame:
    rows, path = records(spark, d), shared(spark, "io03")
    store.write_jsonl(rows, path)
    store.write_jsonl(rows.where("state <> 'F'"), path)
    return store.read_jsonl(spark, path, rows.schema)


@query("SELECT count(*) AS seen, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus <> 'F') AS rejected, count(*) FILTER (o_orderstatus = 'F') AS stored, count(*) AS audited FROM orders")
def io04_two_sinks(spark: SparkSession, d: str) -> DataFrame:
    rows, kept, audit = records(spark, d), shared(spark, "io04"), shared(spark, "io04a")
    n = store.write_split(rows, F.col("state") == "F", kept, audit)
    stored = store.read_jsonl(spark, kept, rows.schema).agg(F.count("*").alias("stored"))
    audited = store.read_jsonl(spark, audit, rows.schema).agg(F.count("*").alias("audited"))
    return spark.createDataFrame([n], "seen long, accepted long, rejected long").crossJoin(stored).crossJoin(audited)


@query("SELECT c_custkey AS repo, arg_max(o_orderkey, o_orderkey) AS cursor, coalesce(arg_max(o_orderstatus = 'F', o_orderkey), false) AS completed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def io05_cursors(spark: SparkSession, d: str) -> DataFrame:
    updates = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("cursor"), (F.col("o_orderstatus") == "F").alias("completed"), F.col("o_orderkey").alias("at"))
    return co.cursors(updates, table(spark, d, "customer").select(F.col("c_custkey").alias("repo")), "repo", "at")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id % 40 * (event_id % 3) END AS r, CASE WHEN event_id % 11 > 0 THEN user_id END AS s FROM events)
SELECT event_id, CASE WHEN r IS NULL OR r > 10 THEN 'go' WHEN r > 0 THEN 'low' WHEN s IS NULL THEN 'unknown' WHEN greatest(s - 5, 0) < 20 THEN 'wait' ELSE 'too_long' END AS action,
CASE WHEN r = 0 AND s IS NOT NULL THEN greatest(s - 5, 0) + 1 END AS seconds FROM e""")
def io11_waits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("now", F.timestamp_seconds(F.lit(1700000000)))
    left = F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 40 * (F.col("event_id") % 3))
    reset = F.when(F.col("event_id") % 11 > 0, F.timestamp_seconds(F.col("user_id") + 1700000000 - 5))
    return e.select("event_id", co.wait(left, reset, F.col("now"), 10, 20).alias("w")).select("event_id", "w.*")


def blobs(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text") + F.when(F.col("doc_id") % 50 == 1, 1).otherwise(0)
    return table(spark, d, "documents").where("doc_id % 20 <> 2").select("doc_id", size.alias("size"), F.encode("text", "utf-8").alias("content"))


@query("SELECT DISTINCT doc_id, CASE WHEN doc_id % 20 = 2 THEN 'missing' ELSE 'truncated' END AS problem FROM labels WHERE doc_id % 20 = 2 OR doc_id % 50 = 1")
def io14_blob_problems(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "labels").select("doc_id")
    return co.blob_problems(wanted.union(wanted), blobs(spark, d), ["doc_id"], "size", "content")


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 20 <> 2 AND doc_id IN (SELECT doc_id FROM labels)")
def sx42_read_side(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "labels").select("doc_id")
    return co.read_side(wanted.union(wanted), blobs(spark, d), ["doc_id"]).select("doc_id", F.sha2("content", 256).alias("sha"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """A name-status text of each order: returned lines are renames, accepted ones additions, others changes in place."""
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    path, old = F.concat(F.lit("m"), p, F.when(F.col("l_partkey") % 4 == 0, ".txt").otherwise(".py")), F.concat(F.lit("o"), s, F.lit(".py"))
    entry = F.when(F.col("l_returnflag") == "R", F.concat_ws("\0", F.lit("R090"), old, path)).when(F.col("l_returnflag") == "A", F.concat_ws("\0", F.lit("A"), path)).otherwise(F.concat_ws("\0", F.lit("M"), path))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), entry.alias("e"))
    return lines.groupBy("sha").agg(F.concat(F.array_join(F.sort_array(F.collect_list("e")), "\0"), F.lit("\0")).alias("status"))


LOG = "l AS (SELECT l_orderkey AS sha, l_returnflag AS f, 'm' || l_partkey || CASE WHEN l_partkey % 4 = 0 THEN '.txt' ELSE '.py' END AS p, 'o' || l_suppkey || '.py' AS o FROM lineitem)"


@query(f"WITH {LOG} SELECT sha, f AS status, CASE WHEN f = 'R' THEN o END AS before, p AS after FROM l WHERE f <> 'N'")
def io16_structural_history(spark: SparkSession, d: str) -> DataFrame:
    return co.structural_history(log(spark, d), "sha", "status")


@query(f"WITH {LOG} SELECT sha, p AS path FROM l WHERE p LIKE '%.py' UNION SELECT sha, o FROM l WHERE f = 'R'")
def io17_changed_paths(spark: SparkSession, d: str) -> DataFrame:
    return co.changed_paths(log(spark, d), "sha", "status")


@query(f"WITH {LOG} SELECT sha, p AS path FROM l UNION SELECT sha, o FROM l WHERE f = 'R'")
def sx06_all_changed_paths(spark: SparkSession, d: str) -> DataFrame:
    return co.changed_paths(log(spark, d), "sha", "status", "")


@query("SELECT l_orderkey AS sample_id, count(DISTINCT l_returnflag || l_linestatus) AS n, bool_or(l_returnflag = 'R') AS r_done, false AS x_done FROM lineitem GROUP BY 1")
def io19_tools_done(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("name"), F.col("l_tax").alias("value"), F.struct("l_linenumber", "l_partkey", "l_tax").alias("at"))
    rows = store.merge_sparse(lines, "sample_id", "name", "value", "at")
    return rows.select("sample_id", F.size("values").cast("long").alias("n"), co.is_done(F.col("values"), "R").alias("r_done"), co.is_done(F.col("values"), "X").alias("x_done"))


@query("""WITH r AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS path, CASE WHEN o_orderkey % 9 > 0 THEN 'c' || (o_orderkey // 2 * CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 7 END) END AS s, o_orderkey % 13 AS l, o_orderkey % 4 AS g FROM orders)
SELECT * FROM (SELECT path, CASE WHEN s IS NULL OR path <> min(path) OVER (PARTITION BY s) THEN 'id' WHEN l NOT IN (0, 1) THEN 'label' WHEN g IN (1, 2) THEN 'graph' END AS problem FROM r) WHERE problem IS NOT NULL""")
def io21_sample_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("c"), F.floor(k / 2) * F.when(k % 5 == 0, 1).otherwise(7))
    graph = F.when(k % 4 == 0, "a/../graph.pt").when(k % 4 == 1, "a/../../graph.pt").when(k % 4 == 2, "/graph.pt").otherwise("before/graph.pt")
    rows = table(spark, d, "orders").select(F.lpad(k.cast("string"), 12, "0").alias("path"), F.when(k % 9 > 0, name).alias("sample_id"), (k % 13).alias("label"), graph.alias("graph_path"))
    return co.sample_problems(rows)


@query("SELECT o_orderkey AS sample_id, o_custkey AS repo, o_orderpriority AS title, ['TRAIN', 'VAL', 'TEST'][1 + c_nationkey % 3] AS split FROM orders JOIN customer ON c_custkey = o_custkey")
def io24_manifest(spark: SparkSession, d: str) -> DataFrame:
    splits = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("c_nationkey") % 3 + 1).alias("split"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("title"))
    out, path = co.manifest(rows, splits, "repo", {"train": "TRAIN", "validation": "VAL", "test": "TEST"}, ["sample_id", "repo", "title"]), shared(spark, "io24")
    store.write_jsonl(out, path)
    return store.read_jsonl(spark, path, out.schema)


@query("SELECT l_orderkey AS sample, count(*) AS nodes, round(sum(l_tax), 4) AS tax, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1")
def io26_packed(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.array("l_tax", "l_quantity").alias("features"))
    names, path = ["tax", "quantity"], shared(spark, "io26")
    co.pack(nodes, names, path)
    f = F.col("features")
    return co.load_packed(spark.read.parquet(path), names).groupBy("sample").agg(F.count("*").alias("nodes"), F.round(F.sum(f[0]), 4).alias("tax"), F.round(F.sum(f[1]), 4).alias("quantity"))


@query(f"WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, ts + to_milliseconds((value * 60000)::BIGINT) AS done FROM events) SELECT start, count(*) AS n FROM w WHERE done < TIMESTAMP '2024-01-20' GROUP BY 1 HAVING start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE ts + to_milliseconds((value * 60000)::BIGINT) < TIMESTAMP '2024-01-20')")
def st04_second_time(spark: SparkSession, d: str) -> DataFrame:
    """The watermark is on the creation time; rows are taken by the time they were done."""
    done = F.timestamp_millis(F.unix_millis("ts") + F.round(F.col("value") * 60000).cast("long"))
    stream = events(spark, d).where(done < F.timestamp_seconds(F.lit(1705708800)))
    return naive(st.drain(st.complete_until(stream, "ts", "1 hour", "6 hours")), "start")


@query("SELECT count(*) AS traversed, count(*) AS stored, 0 AS missing, 0 AS surplus FROM events")
def st05_stored_is_traversed(spark: SparkSession, d: str) -> DataFrame:
    stored = st.drain(events(spark, d)).select("event_id")
    both = table(spark, d, "events").select("event_id", F.lit(1).alias("t")).join(stored.withColumn("s", F.lit(1)), "event_id", "full_outer")
    return both.agg(F.count("t").alias("traversed"), F.count("s").alias("stored"), F.count_if(F.col("s").isNull()).cast("int").alias("missing"), F.count_if(F.col("t").isNull()).cast("int").alias("surplus"))


@query("SELECT c_custkey AS sha, coalesce(n, 0) AS links, n IS NOT NULL AS was_stored FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def sx02_compute_or_read(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("sha")).agg(F.count("*").alias("links")).withColumn("was_stored", F.lit(True))
    needed = table(spark, d, "customer").select(F.col("c_custkey").alias("sha"))
    return co.completed(needed, stored, "sha", lambda keys: keys.withColumns({"links": F.lit(0).cast("long"), "was_stored": F.lit(False)}))


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Each order has the one before it as first parent; every third has a second one, the order after it."""
    k = F.col("o_orderkey")
    of = F.filter(F.array(F.when(k > 0, k - 1), F.when((k > 0) & (k % 3 == 0), k + 1)), lambda x: x.isNotNull())
    return table(spark, d, "orders").select(k.alias("sha"), F.posexplode(of).alias("position", "n")).select("sha", "position", F.concat(F.lit("c"), F.col("n")).alias("parent"))


@query("SELECT o_orderkey AS sha, 'c' || (o_orderkey - 1) AS before_sha FROM orders WHERE o_orderkey > 0")
def sx04_commit_pairs(spark: SparkSession, d: str) -> DataFrame:
    return co.commit_pairs(parents(spark, d))


@query("""SELECT o_orderkey AS sha, CASE WHEN o_orderkey > 0 THEN 'c' || (o_orderkey - 1) END AS before_sha, CASE WHEN o_orderkey = 0 THEN 'unresolved' WHEN (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) OR (o_orderkey % 3 > 0 AND o_orderkey % 4 <> 1) THEN 'unverified'
WHEN o_orderkey % 5 = 0 THEN 'wrong_before' WHEN o_orderkey % 3 = 0 THEN 'merge_head_verified' ELSE 'single_commit_boundary' END AS status FROM orders""")
def sx05_verified_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    head = F.when(k % 2 == 0, F.concat(F.lit("C"), k + 1))
    rows = table(spark, d, "orders").select(k.alias("sha"), head.alias("head_sha"), (k % 4).alias("commits"), F.when(k % 5 == 0, "other").alias("before_sha"))
    return co.verified_pairs(rows, parents(spark, d))


@query("SELECT doc_id, n_chars, quality, n_chars % 7 AS seen FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 = 0")
def sx15_whole_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    history = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") % 7).alias("seen"))
    return co.whole_samples(docs.select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality"), history, "doc_id")


@query("SELECT l_orderkey AS sample, coalesce(max(l_tax) FILTER (l_returnflag = 'A'), 0) AS A, coalesce(max(l_tax) FILTER (l_returnflag = 'R'), 0) AS R, 0::DOUBLE AS X FROM lineitem GROUP BY 1")
def sx16_map_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("f")).agg(F.max("l_tax").alias("t"))
    rows = lines.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("f", "t"))).alias("values"))
    return co.map_columns(rows, "values", ["A", "R", "X"])


@query("SELECT * FROM (SELECT p_partkey AS name, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'not finite' WHEN p_size % 10 = 0 THEN 'no spread' END AS problem FROM part) WHERE problem IS NOT NULL")
def sx17_scaler_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    mean = F.when(k % 5 == 0, float("nan")).otherwise(F.col("p_retailprice"))
    std = F.when(k % 7 == 0, float("inf")).otherwise(F.col("p_size") % 10)
    return co.scaler_problems(table(spark, d, "part").select(k.alias("name"), mean.alias("mean"), std.cast("double").alias("std")))


@query("SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'prepare' WHEN o_orderkey % 4 = 1 THEN 'refuse' ELSE 'reuse' END AS action FROM orders")
def sx20_live_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    live = table(spark, d, "orders").select(k.alias("sample_id"), F.when(k % 5 > 0, F.col("o_custkey")).alias("head"), F.col("o_orderstatus").alias("base"))
    stored = live.where("sample_id % 3 <> 0").withColumn("base", F.when(F.col("sample_id") % 4 == 1, "Z").otherwise(F.col("base")))
    return co.reuse(live, stored, "sample_id", ["head", "base"])


@query("""WITH p AS (SELECT o_custkey AS repo, o_orderkey // 400 AS page, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT c_custkey AS repo, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS cur, c_custkey % 7 = 0 AS done FROM customer),
a AS (SELECT repo, page, n, sum(n) OVER (PARTITION BY repo ORDER BY page) - n AS b, max(page) OVER (PARTITION BY repo) AS last FROM p JOIN s USING (repo) WHERE NOT done AND page > coalesce(cur, -1)),
t AS (SELECT repo, sum(n) FILTER (b < 4) AS k, max(page) FILTER (b < 4) AS pos, max(last) AS last FROM a GROUP BY 1)
SELECT s.repo, coalesce(k, 0)::BIGINT AS retrieved, CASE WHEN pos < last THEN pos END AS cursor, last IS NULL OR pos = last AS completed FROM s LEFT JOIN t USING (repo)""")
def io06_resumed(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo"), F.floor(F.col("o_orderkey") / 400).alias("page")).agg(F.count("*").alias("n"))
    k = F.col("c_custkey")
    return co.resumed(pages, table(spark, d, "customer").select(k.alias("repo"), F.when(k % 3 == 0, 1).alias("cursor"), (k % 7 == 0).alias("completed")), 4)


@query("""WITH n AS (SELECT user_id AS repo, hour(ts) // 6 + 4 * (date_diff('day', TIMESTAMP '2024-01-01', ts) // 5) AS page, ts AS created, ts + to_hours((event_id % 200)::INT) AS merged FROM events),
g AS (SELECT repo, page, count(*) AS n, count(*) FILTER (merged BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20') AS k, bool_or(created > TIMESTAMP '2024-01-20') AS past FROM n GROUP BY 1, 2),
w AS (SELECT *, coalesce(bool_or(past) OVER x, false) AS seen, count(*) OVER x AS i FROM g WINDOW x AS (PARTITION BY repo ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT repo, count(*) FILTER (NOT seen AND i < 14) AS pages, coalesce(sum(n) FILTER (NOT seen AND i < 14), 0)::BIGINT AS scanned, coalesce(sum(k) FILTER (NOT seen AND i < 14), 0)::BIGINT AS collected, coalesce(bool_or(past) FILTER (NOT seen AND i < 14), false) AS past, count(*) AS a FROM w GROUP BY 1)
SELECT repo, pages, scanned, collected, past OR pages = a AS completed, CASE WHEN past THEN 'created_after_window_end' WHEN pages = a THEN 'connection_exhausted' END AS reason FROM r""")
def io07_window_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    page = F.floor(F.hour("ts") / 6) + 4 * F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 5)
    nodes = e.select(F.col("user_id").alias("repo"), page.alias("page"), F.col("ts").alias("created"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 200).cast("int"))).alias("merged"))
    day = lambda x: F.lit(f"2024-01-{x:02d}").cast("timestamp_ntz")
    return co.window_coverage(nodes, e.select(F.col("user_id").alias("repo")).distinct().select("repo", day(3).alias("start"), day(20).alias("end")), 14)


@query("""WITH c AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 40) AS d, bool_or(l_tax > 0.07) AS u, bool_or(l_returnflag IN ('A', 'R') OR l_discount > 0.09) AS s FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderkey % 10 > 0 AS ok, o_orderkey % 4 > 0 AS m, o_orderkey % 3 > 0 AS f, o_orderkey % 5 = 0 AS p FROM orders), j AS (SELECT o.*, c.k IS NOT NULL AS has, r, d, u, s FROM o LEFT JOIN c USING (k))
SELECT count(*) AS records, count(*) FILTER (ok) AS audited, count(*) FILTER (ok AND has) AS production, count(*) FILTER (ok AND NOT m) AS count_mismatches, count(*) FILTER (ok AND d) AS with_deletions, count(*) FILTER (ok AND r) AS with_renames,
count(*) FILTER (ok AND u) AS with_parse_errors, count(*) FILTER (ok AND has AND f) AS full_followup, count(*) FILTER (ok AND has AND f AND NOT p AND m) AS checks_passed, count(*) FILTER (ok AND s) AS review_candidates FROM j""")
def lb11_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    k, flag = F.col("o_orderkey"), F.col("l_returnflag")
    rows = table(spark, d, "orders").select(k.alias("sample_id"), F.when(k % 10 > 0, "audited").otherwise("git_or_evidence_error").alias("status"), (k % 4 > 0).alias("files_match"), (k % 3 > 0).alias("followup"), (k % 5 == 0).alias("provisional"))
    status = F.when(flag == "R", "R090").when((flag == "A") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40), "D").when(flag == "A", "A").otherwise("M")
    lines = table(spark, d, "lineitem").where("l_suppkey % 3 = 0")  # production files
    return co.audit_summary(rows, lines.select(F.col("l_orderkey").alias("sample_id"), status.alias("status"), F.when(F.col("l_tax") > 0.07, "unresolved").otherwise("parsed").alias("syntax"), (F.col("l_discount") > 0.09).alias("structural")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a' WHEN event_id % 4 < 3 AND event_id % 5 > 0 THEN 'b' END AS answer, CASE WHEN event_id % 4 = 0 THEN 'big' WHEN event_id % 4 < 3 AND event_id % 5 > 0 THEN 'small' END AS used,
CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 < 3 AND event_id % 5 > 0 THEN 'big ' || CASE WHEN event_id % 4 = 1 THEN 'is not available to this key' ELSE 'is rate-limited right now' END || '; answered with small.' END AS note FROM events""")
def xr24_fallback(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    error = F.when(i % 4 == 1, "model").when(i % 4 == 2, "rate").when(i % 4 == 3, "network")
    return table(spark, d, "events").select(i, co.with_fallback(F.lit("a"), error, F.when(i % 5 > 0, "b"), ("big", "small")).alias("x")).select("event_id", "x.*")
