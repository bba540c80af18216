"""Queries of features, answers, explanations and model comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import answers as an
from ..operators import evaluation as ev
from ..operators import explain as ex
from ..operators import features as fe
from ..operators import history_features as hf
from ..operators import models as ml
from ..operators import retrieval as rt
from ..operators import splits as sp
from ..sources.store import table
from . import views as v
from .graph_queries import ALL_TOUCHED, CYCLES, all_touched, snapshot
from .history_queries import change_sets
from .registry import query
from .text_queries import bm25_sql

E, P = v.EDGES, v.PREDICTIONS


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in columns})


COUPLING = ["past_coupling_growth", "past_repository_trend", "past_excess_growth", "past_joined_cycle", "touched_existed_6_months_ago", "touched_mean_coupling", "touched_max_coupling", "touched_in_cycle_share", "repo_mean_coupling", "log_repo_modules"]


@query(f"""WITH RECURSIVE {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)}, {CYCLES}, {ALL_TOUCHED},
d1 AS (SELECT m, count(*) AS k FROM (SELECT src AS m FROM a UNION ALL SELECT dst FROM a) GROUP BY m), d2 AS (SELECT m, count(*) AS k FROM (SELECT src AS m FROM b UNION ALL SELECT dst FROM b) GROUP BY m),
w AS (SELECT (SELECT avg(k) FROM d2) AS mean, (SELECT avg(k) FROM d1) AS old, (SELECT count(*) FROM d2) AS n),
x AS (SELECT sample, avg(d2.k - d1.k) FILTER (d1.k IS NOT NULL AND d2.k IS NOT NULL) AS g, bool_or(d1.k IS NOT NULL AND t.m IN (SELECT m FROM cb) AND t.m NOT IN (SELECT m FROM ca)) AS j, avg(d2.k) AS tm, max(d2.k) AS tx,
      avg((t.m IN (SELECT m FROM cb))::INT) AS cy, avg((d1.k IS NOT NULL)::INT) AS ex FROM t LEFT JOIN d1 ON d1.m = t.m LEFT JOIN d2 ON d2.m = t.m GROUP BY 1)
SELECT sample, round(coalesce(g, 0), 6) AS past_coupling_growth, round(CASE WHEN g IS NULL THEN 0 ELSE mean - old END, 6) AS past_repository_trend, round(coalesce(g - (mean - old), 0), 6) AS past_excess_growth,
CASE WHEN g IS NOT NULL AND j THEN 1.0::DOUBLE ELSE 0 END AS past_joined_cycle, round(ex, 6) AS touched_existed_6_months_ago, round(coalesce(tm, 0), 6) AS touched_mean_coupling, coalesce(tx, 0)::DOUBLE AS touched_max_coupling,
round(cy, 6) AS touched_in_cycle_share, round(mean, 6) AS repo_mean_coupling, round(ln(1 + n), 6) AS log_repo_modules FROM x, w""")
def fe01_coupling_history(spark: SparkSession, d: str) -> DataFrame:
    out = hf.coupling_history(snapshot(spark, d, 1995), snapshot(spark, d, 1996), all_touched(spark, d).withColumn("snap", F.lit("s")))
    return r6(out.select("sample", *COUPLING), *COUPLING)


@query("""WITH s AS (SELECT DISTINCT o_custkey AS repo, o_orderkey AS pr, o_orderdate AS t, lower(o_orderpriority) AS author, l_suppkey AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT DISTINCT repo, pr, t, author FROM s),
f AS (SELECT b.pr, count(DISTINCT a.pr) AS n, count(DISTINCT a.author) AS k FROM s b JOIN s a ON a.repo = b.repo AND a.file = b.file AND b.t > a.t AND b.t <= a.t + INTERVAL 182 DAY GROUP BY 1),
r AS (SELECT b.pr, count(*) AS n FROM p b JOIN p a ON a.repo = b.repo AND b.t > a.t AND b.t <= a.t + INTERVAL 182 DAY GROUP BY 1)
SELECT p.pr, round(ln(1 + coalesce(f.n, 0)), 6) AS log_file_commits, round(ln(1 + coalesce(f.k, 0)), 6) AS log_file_authors, round(ln(1 + coalesce(r.n, 0)), 6) AS log_repo_commits FROM p LEFT JOIN f USING (pr) LEFT JOIN r USING (pr)""")
def fe01_file_activity(spark: SparkSession, d: str) -> DataFrame:
    author = table(spark, d, "orders").select(F.col("o_orderkey").alias("pr"), F.col("o_orderpriority").alias("author"))
    names = ("log_file_commits", "log_file_authors", "log_repo_commits")
    return r6(hf.file_activity(change_sets(spark, d).join(author, "pr")), *names)


@query("""SELECT o_orderkey AS sample, round(epoch(o_orderdate) / 86400 / 365.25::DOUBLE, 6) AS merge_years, round(ln(1 + n), 6) AS log_nodes, round(ln(1 + q), 6) AS log_edges, round(ln(1 + k), 6) AS log_modules
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def fe02_shortcut_features(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("nodes"), F.sum("l_quantity").alias("edges"), F.countDistinct("l_suppkey").alias("modules"))
    rows = table(spark, d, "orders").join(s, "o_orderkey").select(F.col("o_orderkey").alias("sample"), F.col("o_orderdate").alias("merged_at"), "nodes", "edges", "modules")
    return r6(fe.shortcut_features(rows), "merge_years", "log_nodes", "log_edges", "log_modules")


HALVES = "h AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber <= 3) AS na, round(avg(l_tax) FILTER (l_linenumber <= 3), 9) AS ta, count(*) AS nb, round(avg(l_tax), 9) AS tb, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)"


@query(f"WITH {HALVES} SELECT k, na::DOUBLE AS before_n, round(ta, 6) AS before_t, (nb - na)::DOUBLE AS delta_n, round(tb - ta, 6) AS delta_t, c::DOUBLE AS change_c FROM h")
def fe04_metric_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    first = F.col("l_linenumber") <= 3
    s = lines.groupBy("k").agg(
        F.count_if(first).alias("na"), F.round(F.avg(F.when(first, F.col("l_tax"))), 9).alias("ta"), F.count("*").alias("nb"), F.round(F.avg("l_tax"), 9).alias("tb"), F.count_if(F.col("l_returnflag") == "R").alias("c")
    )
    out = fe.metric_columns(s.select("k", F.col("na").alias("n"), F.col("ta").alias("t")), s.select("k", F.col("nb").alias("n"), F.col("tb").alias("t")), s, "k", ["n", "t"], ["c"])
    return r6(out, "before_t", "delta_t")


TOTALS = """m AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber <= 2 THEN 'before' ELSE 'after' END AS side, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS t FROM lineitem GROUP BY 1, 2),
s AS (SELECT k, max(t) FILTER (side = 'before') AS before, max(t) FILTER (side = 'after') AS after FROM m GROUP BY 1)"""


@query(f"WITH {TOTALS} SELECT k, before, after, after - before AS delta FROM s")
def fe14_side_totals(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("l_linenumber") <= 2, "before").otherwise("after").alias("side")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), side, "l_quantity", "l_returnflag")
    return fe.side_totals(lines.where("l_returnflag <> 'N'"), "k", "l_quantity", lines)


@query(f"WITH {TOTALS} SELECT k, after - before AS delta FROM s")
def fe09_side_deltas(spark: SparkSession, d: str) -> DataFrame:
    return fe14_side_totals(spark, d).select("k", "delta")


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 400 > 0 THEN n_chars::DOUBLE END AS size, CASE WHEN doc_id % 7 > 0 THEN (n_chars % 13)::DOUBLE END AS delta_size, lang = 'en' AS train FROM documents),
m AS (SELECT median(size) FILTER (train) AS a, median(delta_size) FILTER (train) AS b FROM x) SELECT doc_id, coalesce(size, a) AS size, coalesce(delta_size, b) AS delta_size FROM x, m""")
def fe13_tool_features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.when(k % 400 > 0, F.col("n_chars").cast("double")).alias("size"), F.when(k % 7 > 0, (F.col("n_chars") % 13).cast("double")).alias("delta_size"))
    return fe.tool_features(rows, "doc_id", F.col("lang") == "en", ["size", "delta_size"])[1]


# Evaluation

POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
BOOT = f"""b AS (SELECT r, label, ('0x' || substr(md5('boot:' || r || ':' || sample_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM p, range(0, 1000) x(r)),
w AS (SELECT r, label, {" + ".join(f"(u >= {x})::INT" for x in POISSON)} AS w FROM b), g AS (SELECT sum(w * label)::DOUBLE / sum(w) AS mean FROM w GROUP BY r)"""


@query(f"WITH {P}, {BOOT}, q AS (SELECT quantile_cont(mean, [0.025, 0.975]) AS q FROM g) SELECT round(q[1], 6) AS low, round(q[2], 6) AS high FROM q")
def ev07_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.middle_95(ev.bootstrap_means(v.predictions(spark, d), "sample_id", "label", 1000), "mean"), "low", "high")


@query(f"WITH {P}, {BOOT}, o AS (SELECT list(mean ORDER BY mean) AS m FROM g) SELECT round(m[26], 6) AS low, round(m[976], 6) AS high FROM o")
def ev14_order_bounds(spark: SparkSession, d: str) -> DataFrame:
    return r6(ev.order_bounds(ev.bootstrap_means(v.predictions(spark, d), "sample_id", "label", 1000), "mean"), "low", "high")


@query(f"WITH {P} SELECT split, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM p WHERE sample_id % 3 > 0 GROUP BY 1")
def ev09_covered_rows(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d).withColumn("tool", F.when(F.col("sample_id") % 3 > 0, F.col("score")))
    return ev.confusion(ev.covered(p, "tool"), ["split"], 0.5).select("split", "tp", "fp", "fn")


@query(f"WITH {P} SELECT split, count(*) AS rows, sum(label)::BIGINT AS risky, count(*) FILTER (score >= 0.5) AS flagged, round(avg(score), 3) AS mean_score FROM p GROUP BY 1")
def ev21_score_table(spark: SparkSession, d: str) -> DataFrame:
    return ev.score_table(v.predictions(spark, d), 0.5)


MODELS = f"""{P}, l AS (SELECT split, 'length' AS model, score, label FROM p UNION ALL SELECT split, 'folded', round(1 - abs(score - 0.6), 2), label FROM p UNION ALL SELECT split, 'always', 0.5, label FROM p),
s AS (SELECT split, model, score, sum(label) AS h, count(*) AS n FROM l GROUP BY 1, 2, 3),
w AS (SELECT split, model, h, sum(h) OVER x AS tp, sum(n) OVER x AS seen, sum(h) OVER (PARTITION BY split, model) AS pos FROM s WINDOW x AS (PARTITION BY split, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT split, model, round(coalesce(sum(h::DOUBLE / nullif(pos, 0) * tp / seen), 0), 6) AS ap FROM w GROUP BY 1, 2)"""


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d)
    one = lambda name, s: p.select("split", F.lit(name).alias("model"), "label", s.alias("score"))
    rows = one("length", F.col("score")).union(one("folded", F.round(1 - F.abs(F.col("score") - 0.6), 2))).union(one("always", F.lit(0.5)))
    return r6(ev.average_precision(rows, ["split", "model"]), "ap")


@query(f"WITH {MODELS} SELECT split, model, ap FROM m")
def ml13_shortcut_baselines(spark: SparkSession, d: str) -> DataFrame:
    return model_scores(spark, d)


@query(f"""WITH {MODELS}, b AS (SELECT split, arg_min(model, (-ap, model)) AS baseline, max(ap) AS baseline_ap FROM m WHERE model <> 'folded' GROUP BY 1)
SELECT m.split AS "by", baseline, baseline_ap, ap, CASE WHEN ap > baseline_ap THEN 'beats' ELSE 'does not beat' END AS verdict FROM m JOIN b USING (split) WHERE model = 'folded'""")
def ev22_shortcut_verdict(spark: SparkSession, d: str) -> DataFrame:
    return an.best_baseline(model_scores(spark, d).withColumnRenamed("split", "by"), "folded")


FUSED = f"""{P}, y AS (SELECT label, score AS a, 1 - abs(score - 0.6) AS b FROM p), g AS (SELECT round(x * 0.05::DOUBLE, 2) AS alpha FROM range(0, 21) t(x)),
l AS (SELECT alpha, label, round(1 / (1 + exp(-(alpha * ln(greatest(least(a, 1 - 1e-6), 1e-6) / (1 - greatest(least(a, 1 - 1e-6), 1e-6))) + (1 - alpha) * ln(greatest(least(b, 1 - 1e-6), 1e-6) / (1 - greatest(least(b, 1 - 1e-6), 1e-6)))))), 9) AS s FROM y, g),
c AS (SELECT alpha, s, sum(label) AS h, count(*) AS n FROM l GROUP BY 1, 2), w AS (SELECT alpha, h, sum(h) OVER x AS tp, sum(n) OVER x AS seen, sum(h) OVER (PARTITION BY alpha) AS pos FROM c WINDOW x AS (PARTITION BY alpha ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT alpha, sum(h::DOUBLE / pos * tp / seen) AS ap FROM w GROUP BY alpha)"""


@query(f"WITH {FUSED} SELECT alpha, round(ap, 6) AS ap FROM m ORDER BY round(ap, 12) DESC, alpha DESC LIMIT 1")
def ml06_best_weight(spark: SparkSession, d: str) -> DataFrame:
    rows = v.predictions(spark, d).select("label", F.col("score").alias("a"), (1 - F.abs(F.col("score") - 0.6)).alias("b"))
    return r6(ev.late_fusion(rows, "a", "b", [round(i * 0.05, 2) for i in range(21)]).limit(1), "ap")


ITEMS = """i AS (SELECT conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'off-topic' ELSE 'facts' END AS topic, conv_id % 5 = 0 AS refuse, conv_id % 4 AS k, conv_id % 3 > 0 AS grounded FROM (SELECT DISTINCT conv_id FROM conversations)),
s AS (SELECT id, topic, k <> 3 AS retrieval, CASE WHEN k = 0 THEN 1.0::DOUBLE WHEN k = 1 THEN 1 WHEN k = 2 THEN 0.5 ELSE 0 END AS facts, grounded, NOT refuse OR k = 1 AS refusal_ok FROM i)"""


def answered(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    k, words = F.col("id") % 4, lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<array<string>>")
    return ids.select(
        "id", F.when(F.col("id") % 5 == 0, "off-topic").otherwise("facts").alias("topic"), words("model").alias("expect_cards"), (F.col("id") % 5 == 0).alias("refuse"),
        F.when(k == 0, none).otherwise(F.array(words("5–6", "never"), words("of  the  GNN"))).alias("must_include"),
        F.when(k == 1, "I don't have it, but 5-6 of the gnn").when(k == 2, "It is 5—6").otherwise("other").alias("text"),
        F.when(k == 3, words("data")).otherwise(words("data", "model")).alias("cards"), (F.col("id") % 3 > 0).alias("grounded"),
    )


@query(f"WITH {ITEMS} SELECT id, topic, retrieval, facts, grounded, refusal_ok, retrieval AND facts = 1 AND grounded AND refusal_ok AS passed FROM s")
def ev18_answer_scores(spark: SparkSession, d: str) -> DataFrame:
    return an.score_answers(answered(spark, d))


@query(f"WITH {ITEMS} SELECT count(*) AS questions, round(avg(retrieval::INT), 6) AS hit_rate, round(avg(facts), 6) AS fact_accuracy, round(avg(grounded::INT), 6) AS grounded_rate, count(*) FILTER (topic = 'off-topic' AND refusal_ok) AS right_refusals, count(*) FILTER (topic = 'off-topic') AS refusals, count(*) FILTER (retrieval AND facts = 1 AND grounded AND refusal_ok) AS passed FROM s")
def sx24_answer_summary(spark: SparkSession, d: str) -> DataFrame:
    return r6(an.summary(an.score_answers(answered(spark, d))), "hit_rate", "fact_accuracy", "grounded_rate")


@query("""WITH q AS (SELECT turn AS position, CASE WHEN text IS NULL THEN 'x' ELSE conv_id || ':' || (turn // 2) END AS id, CASE WHEN role = 'assistant' THEN conv_id || ':' || turn END AS parent FROM conversations)
SELECT id, 'duplicate' AS problem FROM q GROUP BY id HAVING count(*) > 1 UNION ALL SELECT q.id, 'parent' FROM q LEFT JOIN (SELECT id AS p, min(position) AS f FROM q GROUP BY 1) ON p = parent WHERE parent IS NOT NULL AND (f IS NULL OR f >= position)""")
def sx25_question_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    name = lambda t: F.concat_ws(":", "conv_id", t.cast("string"))
    ids = F.when(F.col("text").isNull(), "x").otherwise(name(F.floor(F.col("turn") / 2)))
    return an.question_problems(rows.select(F.col("turn").alias("position"), ids.alias("id"), F.when(F.col("role") == "assistant", name(F.col("turn"))).alias("follow_up_of")))


@query(f"""WITH {ITEMS} SELECT id, '| ' || id || ' | Q' || id || ' | ' || CASE WHEN retrieval THEN 'yes' ELSE 'NO' END || ' | ' || (facts * 100)::INT || '% | ' || CASE WHEN grounded THEN 'yes' ELSE 'NO' END || ' | ' || CASE WHEN retrieval AND facts = 1 AND grounded AND refusal_ok THEN 'yes' ELSE 'NO' END || ' |' AS row FROM s""")
def sx26_answer_rows(spark: SparkSession, d: str) -> DataFrame:
    items = answered(spark, d)
    return an.table_rows(an.score_answers(items), items.select("id", F.concat(F.lit("Q"), F.col("id").cast("string")).alias("question")))


PINS = """p AS (SELECT l_orderkey AS q, l_partkey AS card, l_linenumber = 1 AS pr, l_linenumber * 1000000 + l_suppkey AS pos FROM lineitem WHERE l_linenumber <= 1 AND l_orderkey % 2 = 0),
f AS (SELECT l_orderkey AS q, l_partkey AS card, max((l_returnflag = 'R')::INT) = 1 AS pr, max(l_quantity) AS score, min(l_linenumber * 1000000 + l_suppkey) AS pos FROM lineitem GROUP BY 1, 2)"""
PLACED = f"""{PINS}, h AS (SELECT q, card, bool_or(pr) AS pr, min(pos) AS pos FROM p GROUP BY 1, 2), n AS (SELECT q, count(*) AS n, bool_or(pr) AS named FROM h GROUP BY 1),
a AS (SELECT q, card, row_number() OVER (PARTITION BY q ORDER BY pos, card) AS place FROM h),
r AS (SELECT f.*, coalesce(n, 0) AS n, coalesce(named, false) AS named, sum(pr::INT) OVER (PARTITION BY f.q ORDER BY score DESC, pos, card ROWS UNBOUNDED PRECEDING) AS nth FROM f LEFT JOIN n ON n.q = f.q WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.q = f.q AND h.card = f.card)),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos, card) + n AS place FROM r WHERE NOT pr OR (NOT named AND nth = 1)),
o AS (SELECT q AS question, card, place FROM a UNION ALL SELECT q, card, place FROM k WHERE place <= CASE WHEN named THEN least(greatest(3, n), n + 2) ELSE greatest(3, n) END)"""


def sent_cards(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("card"), "l_linenumber", "l_returnflag", "l_quantity", (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("position"))
    pinned = lines.where("l_linenumber <= 1 AND question % 2 = 0").withColumn("is_pr", F.col("l_linenumber") == 1)
    found = lines.groupBy("question", "card").agg(F.bool_or(F.col("l_returnflag") == "R").alias("is_pr"), F.max("l_quantity").alias("score"), F.min("position").alias("position"))
    return an.with_pinned(pinned, found, 3)


@query(f"WITH {PLACED} SELECT question, card, place FROM o")
def xr16_pinned_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return sent_cards(spark, d)


@query(f"WITH {PLACED} SELECT question, count(*) AS cards, max(place) AS last FROM o GROUP BY 1")
def wn15_card_limits(spark: SparkSession, d: str) -> DataFrame:
    return sent_cards(spark, d).groupBy("question").agg(F.count("*").alias("cards"), F.max("place").alias("last"))


@query(bm25_sql(1.2, False, True, 1))
def xr15_best_by_text(spark: SparkSession, d: str) -> DataFrame:
    scored = rt.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text")
    return rt.top_k(scored, "item_id", "doc_id", 1).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'pr:' || p_partkey ELSE '' END AS unknown, CASE WHEN p_size > 10 AND p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS wrong FROM part")
def xr19_checked_answers(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("See [pr:"), k.cast("string"), F.lit("] and [dataset]: "), size.cast("string"), F.lit(" files."))
    cards = F.when(k % 3 == 0, F.array(F.lit("dataset"))).otherwise(F.array(F.lit("dataset"), F.concat(F.lit("pr:"), k.cast("string"))))
    values = F.when(k % 2 == 0, F.array(F.lit(0.5))).otherwise(F.array(size.cast("double")))
    out = rt.check_answer(text, cards, values)
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", out["unknown_citations"]).alias("unknown"), F.concat_ws(",", out["unsupported_numbers"]).alias("wrong"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'missing_right' ELSE 'label' END AS problem FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 1")
def xr22_input_check(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    return sp.alignment_problems(o, o.where("id % 9 > 0").withColumn("label", F.when(F.col("id") % 10 == 1, "x").otherwise(F.col("label"))), "id", ["label"])


# Explanations


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_tax - 0.04) * l_quantity, 9) AS attribution FROM lineitem")
def xr01_linear_gradients(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_tax") - 0.04).alias("w"), F.col("l_quantity").alias("x"))
    return ex.linear_gradients(parts, "w", "x").select("l_orderkey", "l_linenumber", "l_partkey", F.round("attribution", 9).alias("attribution"))


STEPS = "list_sum(list_transform(range(1, {n} + 1), lambda i: 1 / (1 + exp(-(0.05 * p_size * (i - 0.5::DOUBLE) / {n}))) * (1 - 1 / (1 + exp(-(0.05 * p_size * (i - 0.5::DOUBLE) / {n})))) * 0.05)) / {n} * p_size"


@query(f"SELECT p_partkey, round({STEPS.format(n=32)}, 8) AS attribution FROM part")
def xr02_node_gradients(spark: SparkSession, d: str) -> DataFrame:
    out = an.node_gradients(table(spark, d, "part").select("p_partkey", "p_size"), F.lit(0.05), F.col("p_size").cast("double"), 32)
    return out.select("p_partkey", F.round("attribution", 8).alias("attribution"))


@query(f"SELECT p_partkey, round({STEPS.format(n=4)}, 8) AS attribution, 4 AS steps FROM part")
def xr10_adaptive_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_size")
    out, steps = an.adaptive_gradients(rows, "p_partkey", F.lit(0.05), F.col("p_size").cast("double"))
    return out.select("p_partkey", F.round("attribution", 8).alias("attribution"), F.lit(steps).alias("steps"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS sample, l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation, round((l_tax - 0.04) * l_quantity, 6) AS attribution FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY abs(attribution) DESC, src, dst, relation) AS k FROM e),
b AS (SELECT DISTINCT l_orderkey AS sample, l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation FROM lineitem WHERE l_linenumber % 2 = 0), t AS (SELECT DISTINCT l_orderkey AS sample, l_suppkey AS node FROM lineitem WHERE l_linenumber = 1)
SELECT r.sample, r.src, r.dst, r.relation, attribution, b.sample IS NULL AS added, t.node IS NOT NULL AS touched_src, u.node IS NOT NULL AS touched_dst FROM r LEFT JOIN b ON b.sample = r.sample AND b.src = r.src AND b.dst = r.dst AND b.relation = r.relation
LEFT JOIN t ON t.sample = r.sample AND t.node = r.src LEFT JOIN t u ON u.sample = r.sample AND u.node = r.dst WHERE k <= 3""")
def xr06_ranked_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.round((F.col("l_tax") - 0.04) * F.col("l_quantity"), 6).alias("attribution"), "l_linenumber"
    )
    e = lines.drop("l_linenumber").distinct()
    return an.ranked_edges(e, lines.where("l_linenumber % 2 = 0"), lines.where("l_linenumber = 1").select("sample", F.col("src").alias("node")), 3)


@query("""WITH h AS (SELECT l_orderkey AS sample, l_suppkey AS hunk, round(sum((l_tax - 0.04) * 10), 9) AS own, count(*) AS size FROM (SELECT l_orderkey, l_suppkey, l_tax FROM lineitem) GROUP BY 1, 2),
r AS (SELECT *, sum(own) OVER (PARTITION BY sample) AS s, row_number() OVER (PARTITION BY sample ORDER BY hunk) AS k FROM h) SELECT sample, hunk, round(1 / (1 + exp(-s)) - 1 / (1 + exp(-(s - own))), 6) AS effect FROM r WHERE k <= 20""")
def xr08_hunk_occlusion(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("hunk"), ((F.col("l_tax") - 0.04) * 10).alias("v"))
    return r6(an.without_each(parts, "sample", "hunk", "v", []), "effect")


@query()
def ml04_perceptron(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    from .model_queries import vectors

    rows = vectors(spark, d).withColumn("features", array_to_vector("x"))
    return ml.probability(ml.perceptron(rows, 64, 8), rows).select("vec_id", "label", "score")


@query("SELECT label, round((SELECT count(*) FROM documents JOIN labels USING (doc_id))::DOUBLE / (2 * count(*)), 6) AS weight FROM (SELECT quality AS label FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def ml02_class_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"))
    return ml.balanced(rows, "label").groupBy("label").agg(F.round(F.first("weight"), 6).alias("weight"))
