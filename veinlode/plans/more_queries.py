"""Queries of further records, checks, joins and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation as ev
from ..operators import features as fe
from ..operators import graph as g
from ..operators import labels as lb
from ..operators import splits as sp
from ..sources import history as hs
from ..sources.store import table
from . import views as v
from .registry import query

E, P = v.EDGES, v.PREDICTIONS


@query("""SELECT 'own/n' || c_nationkey || '#' || c_custkey AS pr_id, c_custkey::INT AS pr_number, c_name AS title, c_acctbal > 0 AS merged, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS author,
2 AS messages, c_custkey % 2 = 0 AS commit_metadata_complete FROM customer""")
def io08_normalise(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    node = F.to_json(F.struct(
        k.alias("number"), F.col("c_name").alias("title"), (F.col("c_acctbal") > 0).alias("merged"), F.when(k % 3 != 0, F.struct(F.col("c_mktsegment").alias("login"))).alias("author"),
        F.struct(F.struct((k % 2 != 0).alias("hasNextPage")).alias("pageInfo"), F.array(*[F.struct(F.struct(F.lit(m).alias("message")).alias("commit")) for m in ("a", "b")]).alias("nodes")).alias("commits"),
    ))
    pages = table(spark, d, "customer").select(node.alias("value"), F.lit("own").alias("owner"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"))
    out = hs.normalised(pages, "value", "owner", "name")
    return out.select("pr_id", "pr_number", "title", "merged", "author", F.size("commit_messages").alias("messages"), "commit_metadata_complete")


@query("""WITH m AS (SELECT l_orderkey, list(l_comment ORDER BY l_linenumber, l_partkey, l_comment) AS m FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::VARCHAR AS l_comment FROM lineitem) GROUP BY 1)
SELECT l_orderkey, array_to_string(m[1:3], '|') AS messages, len(m) <= 3 AS complete FROM m""")
def io09_commit_messages(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    pages = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", at).alias("page"), F.array(at).alias("m"), F.lit(False).alias("more"))
    return hs.commit_messages(pages, "l_orderkey", "page", "m", "more", 3).select("l_orderkey", F.concat_ws("|", "messages").alias("messages"), "complete")


@query("""WITH l AS (SELECT o_orderkey, o_orderdate, (o_orderkey % 500)::INT AS number FROM orders WHERE o_orderkey % 4 <> 3)
SELECT number, arg_max('c' || o_orderkey, (o_orderdate, 'c' || o_orderkey)) AS sha, max(o_orderdate) AS merged_at FROM l GROUP BY number""")
def io13_merged_prs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 500).cast("string")
    subject = F.when(k % 4 == 0, F.concat(F.lit("Merge pull request #"), n, F.lit(" from x"))).when(k % 4 == 3, F.concat(F.lit("Fix #"), n)).otherwise(F.concat(F.lit("Use b (#"), n, F.lit(")")))
    line = F.concat_ws("\t", F.concat(F.lit("c"), k.cast("string")), F.lit("p q"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), subject)
    out = hs.merged_prs(table(spark, d, "orders").select(line.alias("value")))
    return out.select("number", "sha", F.col("merged_at").cast("timestamp_ntz").alias("merged_at"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A::x' || p_partkey || ',M:y:y' WHEN 1 THEN 'R100:x' || p_partkey || ':z,M:y:y' ELSE 'D:x' || p_partkey || ':,M:y:y' END AS changes FROM part""")
def io15_changed_files(spark: SparkSession, d: str) -> DataFrame:
    name, s = F.concat(F.lit("x"), F.col("p_partkey").cast("string")), F.col("p_size") % 3
    text = F.when(s == 0, F.concat(F.lit("A\0"), name)).when(s == 1, F.concat(F.lit("R100\0"), name, F.lit("\0z"))).otherwise(F.concat(F.lit("D\0"), name))
    empty = lambda x: F.coalesce(x, F.lit(""))
    shown = F.transform(hs.changes(F.concat(text, F.lit("\0M\0y\0"))), lambda c: F.concat_ws(":", c["status"], empty(c["before"]), empty(c["after"])))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", shown).alias("changes"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_custkey || '#' || o_orderkey END AS pr_id FROM orders")
def sx08_pr_id(spark: SparkSession, d: str) -> DataFrame:
    explicit = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("  ")
    return table(spark, d, "orders").select("o_orderkey", hs.pr_id(explicit, F.col("o_custkey").cast("string"), F.col("o_orderkey")).alias("pr_id"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 2")
def io27_dev_manifest(spark: SparkSession, d: str) -> DataFrame:
    return hs.first_per_repo(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2)


@query("""SELECT lower(c_mktsegment) AS name, count(*) AS n, bool_and(regexp_full_match(c_mktsegment, '[A-Za-z0-9_.-]+')) AS valid FROM customer GROUP BY 1 HAVING count(*) > 1""")
def fl13_repository_names(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("c_mktsegment").rlike(r"^[A-Za-z0-9_.-]+\z")
    return table(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("name")).agg(F.count("*").alias("n"), F.bool_and(ok).alias("valid")).where("n > 1")


@query("""SELECT 'duplicate' AS problem, count(*) AS n FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing', count(*) FROM events WHERE value IS NULL OR props IS NULL
UNION ALL SELECT 'unknown', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def fl09_provenance(spark: SparkSession, d: str) -> DataFrame:
    e, known = table(spark, d, "events"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    rows = [("duplicate", sp.duplicates(e, "user_id")), ("missing", e.where("value IS NULL OR props IS NULL")), ("unknown", e.join(known, "user_id", "left_anti"))]
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT s_suppkey, 'fl' || (s_suppkey % 3) AS file, s_nationkey IN (1, 2, 3) AS touched FROM supplier")
def gr18_touched_masks(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("fl"), (F.col("s_suppkey") % 3).cast("string")).alias("file"), F.col("s_nationkey").cast("string").alias("path"))
    changed = table(spark, d, "nation").where("n_nationkey IN (1, 2, 3)").select(F.col("n_nationkey").cast("string").alias("path"))
    return g.touched_mask(nodes, changed).select("s_suppkey", "file", "touched")


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}, s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) SELECT 'kept' AS state, count(*) AS n FROM e WHERE src IN (FROM s) AND dst IN (FROM s)
UNION ALL SELECT 'dropped', count(*) FROM e WHERE NOT (src IN (FROM s) AND dst IN (FROM s))""")
def gr21_fit_schema(spark: SparkSession, d: str) -> DataFrame:
    e = v.plain(spark, d, 1995)
    s = table(spark, d, "supplier").where("s_nationkey < 12").select("s_suppkey")
    kept = e.join(s.withColumnRenamed("s_suppkey", "src"), "src", "left_semi").join(s.withColumnRenamed("s_suppkey", "dst"), "dst", "left_semi").select("src", "dst")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n")
    return n(kept, "kept").union(n(e.join(kept, ["src", "dst"], "left_anti"), "dropped"))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS sha, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders),
c AS (SELECT sha, parent AS a, 1 AS n FROM p WHERE parent IS NOT NULL UNION ALL SELECT c.sha, p.parent, n + 1 FROM c JOIN p ON p.sha = c.a WHERE p.parent IS NOT NULL)
SELECT sha, max(n) AS depth FROM c GROUP BY sha""")
def gr20_first_parent_chain(spark: SparkSession, d: str) -> DataFrame:
    from .graph_queries import parents

    return g.chain_facts(parents(spark, d)).select("sha", F.col("depth").cast("int").alias("depth"))


@query(f"""WITH {E}, n AS (SELECT src AS id, src * 10 + dst AS seq FROM edges WHERE year = 1995 UNION ALL SELECT dst, src * 10 + dst FROM edges WHERE year = 1995),
m AS (SELECT id, max(seq) AS last FROM n GROUP BY 1) SELECT id, last, round(last / (SELECT max(abs(last)) FROM m)::DOUBLE, 6) AS scaled FROM m""")
def gr25_view_graph(spark: SparkSession, d: str) -> DataFrame:
    e = v.edges(spark, d, 1995)
    seq = F.col("src") * 10 + F.col("dst")
    m = e.select(F.explode(F.array("src", "dst")).alias("id"), seq.alias("seq")).groupBy("id").agg(F.max("seq").alias("last"))
    top = m.agg(F.max(F.abs("last")).alias("top"))
    return m.crossJoin(F.broadcast(top)).select("id", "last", F.round(F.col("last") / F.col("top"), 6).alias("scaled"))


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS x, l_suppkey AS y FROM lineitem WHERE l_discount >= 0.05), a AS (SELECT l_suppkey AS alt, min(l_suppkey + 1) AS y FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1),
f AS (SELECT DISTINCT l_orderkey AS x, coalesce(a.y, l_suppkey) AS y FROM lineitem LEFT JOIN a ON a.alt = l_suppkey WHERE l_quantity >= 30)
SELECT (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM f)) AS fn""")
def jn14_alias_mapped(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_suppkey").alias("y"), "l_quantity", "l_discount")
    y = F.when(F.col("y") % 2 == 1, F.col("y") + 1).otherwise(F.col("y"))
    found = lines.where("l_quantity >= 30").select("x", y.alias("y"))
    return ev.set_scores(found, lines.where("l_discount >= 0.05"), ["x", "y"], []).select("tp", "fp", "fn")


@query("""WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS t FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1995-03-01' GROUP BY 1)
SELECT s_suppkey AS folder, CASE WHEN a.t IS NOT NULL THEN a.t WHEN s_nationkey < 12 THEN 0 END AS total FROM supplier LEFT JOIN a ON k = s_suppkey""")
def ag14_folder_totals(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_shipdate < TIMESTAMP_NTZ '1995-03-01'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("t"))
    total = F.when(F.col("t").isNotNull(), F.col("t")).when(F.col("s_nationkey") < 12, F.lit(0.0))
    return table(spark, d, "supplier").join(a, "s_suppkey", "left").select(F.col("s_suppkey").alias("folder"), total.alias("total"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS b FROM orders)
SELECT o_custkey, o_orderkey, 'top' AS side FROM r WHERE a <= 3 UNION ALL SELECT o_custkey, o_orderkey, 'bottom' FROM r WHERE b <= 2""")
def wn06_both_ends(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.temporal import ranked_cut

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = ranked_cut(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).withColumn("side", F.lit("top"))
    low = ranked_cut(o, ["o_custkey"], [F.asc("o_totalprice"), F.asc("o_orderkey")], 2).withColumn("side", F.lit("bottom"))
    return top.union(low).select("o_custkey", "o_orderkey", "side")


@query("""WITH h AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('pick:' || doc_id), doc_id) AS r FROM labels) SELECT doc_id, quality FROM h WHERE r <= 20""")
def wn07_balanced_pick(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.temporal import ranked_cut

    h = sp.hash_order(F.col("doc_id"), "pick")
    return ranked_cut(table(spark, d, "labels").select("doc_id", "quality"), ["quality"], [h, F.asc("doc_id")], 20)


@query(f"""WITH {P} SELECT sample_id, label, score FROM p WHERE split IN (SELECT split FROM p GROUP BY 1 HAVING count(DISTINCT label) = 2)""")
def ev15_complete_cases(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d)
    full = p.groupBy("split").agg(F.countDistinct("label").alias("n")).where("n = 2").select("split")
    return p.join(full, "split", "left_semi").select("sample_id", "label", "score")


@query(f"""WITH {P} SELECT split, round(avg(label), 6) AS ap FROM p GROUP BY split""")
def ev06_constant_score(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d).withColumn("score", F.lit(0.5))
    return ev.average_precision(p, ["split"]).withColumn("ap", F.round("ap", 6))


@query("""WITH g AS (SELECT l_orderkey AS q, list(DISTINCT l_suppkey) AS want FROM lineitem WHERE l_quantity > 20 GROUP BY 1), r AS (SELECT l_orderkey AS q, list(DISTINCT l_suppkey) AS got FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
SELECT q, round(len(list_intersect(got, want)) / 3.0::DOUBLE, 6) AS p3, round(len(list_intersect(got, want)) / len(want)::DOUBLE, 6) AS r3 FROM g JOIN r USING (q)""")
def ev13_retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    want = lines.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_suppkey").alias("want"))
    got = lines.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_suppkey").alias("got"))
    hits = F.size(F.array_intersect("got", "want"))
    return want.join(got, "q").select("q", F.round(hits / 3.0, 6).alias("p3"), F.round(hits / F.size("want"), 6).alias("r3"))


WEIGHTS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]


@query(f"""WITH {P}, u AS (SELECT r, label, score AS a, round(1 - abs(score - 0.6), 2) AS b, ('0x' || substr(md5('pair:' || r || ':' || sample_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM p, range(0, 1000) x(r)),
w AS (SELECT r, label, a, b, {" + ".join(f"(u >= {c})::INT" for c in WEIGHTS)} AS w FROM u),
l AS (SELECT r, 'a' AS model, a AS score, label, w FROM w WHERE w > 0 UNION ALL SELECT r, 'b', b, label, w FROM w WHERE w > 0),
s AS (SELECT r, model, score, sum(w * label) AS h, sum(w) AS n FROM l GROUP BY 1, 2, 3),
c AS (SELECT r, model, h, sum(h) OVER x AS tp, sum(n) OVER x AS seen, sum(h) OVER (PARTITION BY r, model) AS pos FROM s WINDOW x AS (PARTITION BY r, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT r, model, coalesce(sum(h::DOUBLE / nullif(pos, 0) * tp / seen), 0) AS ap FROM c GROUP BY 1, 2), d AS (SELECT r, sum(CASE WHEN model = 'a' THEN ap ELSE -ap END) AS d FROM m GROUP BY 1)
SELECT count(*) AS resamples, round(avg(d), 6) AS mean_difference, round(avg((round(d, 9) > 0)::INT), 6) AS share_won FROM d""")
def ev08_paired_average_precision(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d)
    out = ev.paired_comparison(p, p.withColumn("score", F.round(1 - F.abs(F.col("score") - 0.6), 2)), "sample_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_difference", "share_won")})


@query("""WITH x AS (SELECT l_orderkey AS sample, count(*) FILTER (l_returnflag = 'A') AS convention, count(*) FILTER (l_returnflag LIKE 'R%') AS refactor, sum(l_quantity) AS sloc FROM lineitem GROUP BY 1)
SELECT sample, convention, refactor, round(1000.0::DOUBLE * (convention + refactor) / nullif(sloc, 0), 6) AS per_kloc FROM x""")
def fe10_report_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.columns import ratio

    flag = F.col("l_returnflag")
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.count_if(flag == "A").alias("convention"), F.count_if(flag.startswith("R")).alias("refactor"), F.sum("l_quantity").alias("sloc"))
    return x.select("sample", "convention", "refactor", F.round(ratio(1000 * (F.col("convention") + F.col("refactor")), F.col("sloc"), None), 6).alias("per_kloc"))


@query("""WITH m AS (SELECT median(n_chars) FILTER (lang = 'en') AS m FROM documents) SELECT doc_id, coalesce(CASE WHEN doc_id % 9 > 0 THEN n_chars END, m)::DOUBLE AS filled FROM documents, m""")
def fe13_impute_median(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    m = docs.agg(F.percentile(F.when(F.col("lang") == "en", F.col("n_chars")), 0.5).alias("m"))
    return docs.crossJoin(F.broadcast(m)).select("doc_id", F.coalesce(F.when(F.col("doc_id") % 9 > 0, F.col("n_chars").cast("double")), "m").alias("filled"))


HISTORY = """past AS (SELECT b.o_orderkey AS pr, count(*) AS commits, count(DISTINCT a.o_orderpriority) AS authors FROM orders b JOIN orders a ON a.o_custkey = b.o_custkey
AND a.o_orderdate >= date_trunc('month', b.o_orderdate) - INTERVAL 6 MONTH AND a.o_orderdate < date_trunc('month', b.o_orderdate) GROUP BY 1)"""


@query(f"""WITH {HISTORY} SELECT o_orderkey AS pr, round(ln(1 + coalesce(commits, 0)), 6) AS log_commits, round(ln(1 + coalesce(authors, 0)), 6) AS log_authors FROM orders LEFT JOIN past ON pr = o_orderkey""")
def fe01_history_features(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.history_features import recent_activity

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pr"), F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("author"))
    return recent_activity(o, 6).select("pr", *[F.round(c, 6).alias(c) for c in ("log_commits", "log_authors")])


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey < 12 THEN 'merge_commit' WHEN c_acctbal > 0 THEN 'squash_or_rebase' WHEN c_nationkey < 12 THEN 'open' ELSE 'closed' END AS mode FROM customer""")
def lb15_live_mode(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.history_features import live_mode

    mode = live_mode(F.col("c_acctbal") > 0, F.col("c_nationkey") < 12, F.when(F.col("c_nationkey") < 12, 2).otherwise(1))
    return table(spark, d, "customer").select("c_custkey", mode.alias("mode"))


@query("""WITH a AS (SELECT o_orderkey AS sample, (o_totalprice / 1000)::INT % 2 AS label FROM orders), b AS (SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 17 = 0 THEN 1 - (o_totalprice / 1000)::INT % 2 ELSE (o_totalprice / 1000)::INT % 2 END AS label FROM orders WHERE o_orderkey % 13 > 0)
SELECT coalesce(a.sample, b.sample) AS sample, CASE WHEN b.sample IS NULL THEN 'missing_right' ELSE 'label' END AS problem FROM a FULL JOIN b ON a.sample = b.sample WHERE a.label IS DISTINCT FROM b.label""")
def lb12_recomputed_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.round(F.col("o_totalprice") / 1000).cast("int") % 2
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), label.alias("label"))
    other = o.where("sample % 13 > 0").withColumn("label", F.when(F.col("sample") % 17 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return sp.alignment_problems(o, other, "sample", ["label"])


@query("""WITH x AS (SELECT l_orderkey AS sample_id, CASE WHEN l_linenumber = 1 THEN 'refactor' WHEN l_linenumber = 2 THEN 'maybe' END AS decision, l_quantity > 25 AS has, l_suppkey % 5 AS f FROM lineitem WHERE l_linenumber < 4),
p AS (SELECT sample_id, unnest(list_filter([CASE WHEN decision IS DISTINCT FROM 'refactor' THEN 'decision' END, CASE WHEN NOT has THEN 'evidence' END, CASE WHEN f > 2 THEN 'files' END], lambda v: v IS NOT NULL)) AS problem FROM x)
SELECT sample_id, problem, count(*) AS n FROM p GROUP BY 1, 2""")
def lb06_review_violations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    reviews = table(spark, d, "lineitem").where(n < 4).select(
        F.col("l_orderkey").alias("sample_id"), F.when(n == 1, "refactor").when(n == 2, "maybe").alias("decision"),
        F.when(F.col("l_quantity") > 25, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
        F.array(F.col("l_suppkey") % 5).alias("files"), F.array(*[F.lit(i).cast("long") for i in (0, 1, 2)]).alias("changed"),
    )
    return lb.review_violations(reviews, ["refactor", "none"]).groupBy("sample_id", "problem").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT r.rn, s.split, count(*) FILTER (l = 0) AS a, count(*) FILTER (l = 1) AS b, count(DISTINCT repo) AS r FROM (SELECT lang AS split, source AS repo, quality AS l FROM documents JOIN labels USING (doc_id)) s, (SELECT 1 AS rn) r GROUP BY 1, 2)
SELECT split, 'class' AS problem FROM c WHERE least(a, b) < 5 UNION ALL SELECT split, 'repositories' FROM c WHERE r < 15""")
def sp04_cohort_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("split"), F.col("source").alias("repo"), "quality")
    return sp.cohort_violations(rows, "split", "repo", "quality", 5, 15)


@query(f"""WITH {E}, e AS (SELECT DISTINCT src, dst, year FROM edges), t AS (SELECT year, src, count(*) AS n FROM e GROUP BY 1, 2)
SELECT year, count(*) AS nodes, max(n) AS most, round(avg(n), 6) AS mean FROM t GROUP BY year""")
def sx18_graph_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = v.edges(spark, d).select("src", "dst", "year").distinct().groupBy("year", "src").agg(F.count("*").alias("n"))
    return n.groupBy("year").agg(F.count("*").alias("nodes"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("""WITH o AS (SELECT doc_id AS id, n_chars % 5 AS h FROM documents WHERE doc_id % 4 > 0), n AS (SELECT doc_id AS id, n_chars % 5 + (doc_id % 6 = 1)::INT AS h FROM documents WHERE doc_id % 5 > 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'keep' WHEN o.id IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def sx50_store_merge(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.history_features import merge_plan

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 5).alias("h"))
    old = docs.where("id % 4 > 0")
    new = docs.where("id % 5 > 0").withColumn("h", F.col("h") + (F.col("id") % 6 == 1).cast("int"))
    return merge_plan(old, new, "id", "h")


@query("""WITH w AS (SELECT doc_id, greatest(len(string_split(text, ' ')), 1) AS n FROM documents)
SELECT doc_id, len(range(0, least(n, 4000)::BIGINT, 256)) AS windows, n > 4000 AS truncated FROM w""")
def sf21_token_windows(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.size(F.split("text", " ")), F.lit(1))
    starts = F.sequence(F.lit(0), F.least(n, F.lit(4000)) - 1, F.lit(256))
    return table(spark, d, "documents").select("doc_id", F.size(starts).cast("long").alias("windows"), (n > 4000).alias("truncated"))


@query("""WITH x AS (SELECT doc_id, ln(1 + n_chars) AS x FROM documents) SELECT doc_id, round((x - avg(x) OVER ()) / greatest(stddev_pop(x) OVER (), 1e-8), 6) AS z FROM x""")
def fe08_history_scaler(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("z"))
    return fe.apply_scaler(docs, fe.fit_scaler(docs, ["z"], log=False, least=1e-8), ["z"], log=False).select("doc_id", F.round("z", 6).alias("z"))
