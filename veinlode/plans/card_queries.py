"""Queries of cards, messages, notes, blind surveys and graph references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards as cd
from ..operators import evaluation as ev
from ..operators import relations as rl
from ..operators import resolution as rs
from ..sources import store
from ..sources.store import table
from . import views as v
from .collection_queries import shared
from .model_queries import graph, sources
from .registry import query
from .source_queries import PART

E, P = v.EDGES, v.PREDICTIONS
CYCLE, RISEN, STEADY = (t.replace("'", "''") for t in (cd.RISEN_CYCLE, cd.RISEN, cd.STEADY))


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 3 AS place, l_linenumber AS hunk, l_returnflag AS f FROM lineitem),
u AS (SELECT k, place, hunk, min(f) AS f FROM h WHERE hunk <> 2 GROUP BY 1, 2, 3),
x AS (SELECT k, place, 'diff ' || place || chr(10) || string_agg('@@ ' || hunk || chr(10) || '+' || f, chr(10) ORDER BY hunk) AS t FROM u GROUP BY 1, 2)
SELECT k, string_agg(t, chr(10) ORDER BY place) || chr(10) AS diff FROM x GROUP BY 1""")
def xr09_without_a_hunk(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("l_suppkey") % 3
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), place.alias("place"), F.col("l_linenumber").alias("hunk")).agg(F.min("l_returnflag").alias("f"))
    parts = h.select("k", "place", F.concat(F.lit("diff "), F.col("place").cast("string")).alias("header"), "hunk", F.concat(F.lit("@@ "), F.col("hunk").cast("string"), F.lit("\n+"), F.col("f")).alias("text"))
    return cd.rendered(parts, "k", F.lit(2))


@query(f"""WITH x AS (SELECT p_partkey AS k, p_partkey % 2 AS l, p_partkey % 3 = 0 AS c, CASE WHEN p_partkey % 5 > 0 THEN (p_size - 20) / 4.0::DOUBLE END AS g, CASE WHEN p_partkey % 4 = 0 THEN 6 ELSE 12 END AS m FROM part),
y AS (SELECT *, coalesce(replace('{cd.GROWTH}', '{{x}}', format('{{:+.2f}}', g)), '') AS s FROM x)
SELECT k, replace(replace(CASE WHEN l = 1 AND c THEN '{CYCLE}' WHEN l = 1 THEN '{RISEN}' ELSE '{STEADY}' END, '{{m}}', m::VARCHAR), '{{g}}', s) AS words FROM y""")
def sx30_label_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    excess = F.when(k % 5 > 0, (F.col("p_size") - 20) / 4.0)
    return table(spark, d, "part").select(k.alias("k"), cd.label_text(k % 2, F.when(k % 3 == 0, "joined_new_cycle").otherwise("grew"), F.when(k % 4 > 0, 12), excess).alias("words"))


@query("""WITH x AS (SELECT p_partkey AS k, (p_size - 20) / 4.0::DOUBLE AS s, (p_partkey % 41 - 20) / 4.0::DOUBLE AS d FROM part), y AS (SELECT *, format('{:+.2f}', s) AS fs, format('{:+.2f}', d) AS fd,
CASE WHEN s > 0 THEN 'pushed the risk up' WHEN s < 0 THEN 'pushed the risk down' ELSE 'did not move the risk' END AS ps, CASE WHEN d > 0 THEN 'pushed the risk up' WHEN d < 0 THEN 'pushed the risk down' ELSE 'did not move the risk' END AS pd FROM x)
SELECT k, 'In words (layer A): the structure part ' || ps || ' (' || fs || ') and the diff part ' || pd || ' (' || fd || ').' ||
CASE WHEN abs(d) > abs(s) THEN ' The diff part is larger (' || fd || ' vs ' || fs || '), so it had the bigger effect on this score.' WHEN abs(s) > abs(d) THEN ' The structure part is larger (' || fs || ' vs ' || fd || '), so it had the bigger effect on this score.' ELSE '' END AS words FROM y""")
def sx30_layer_words(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), cd.layer_words((F.col("p_size") - 20) / 4.0, (k % 41 - 20) / 4.0).alias("words"))


@query(f"""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
h AS (SELECT a.conv_id, a.n, 'Q: ' || a.text || chr(10) || 'A: ' || b.text AS t FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.n = a.n AND a.role = 'user' AND b.role = 'assistant'),
l AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS r FROM h) WHERE r <= 2 GROUP BY 1)
SELECT c.conv_id, sha256('CARDS:' || chr(10) || chr(10) || '[pr:' || c.conv_id || '] PR' || chr(10) || 'x' || chr(10) || chr(10) || coalesce('{cd.HISTORY}' || chr(10) || chr(10) || l.t || chr(10) || chr(10), '') || 'QUESTION: why') AS message
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN l ON l.conv_id = c.conv_id""")
def sx23_user_message(spark: SparkSession, d: str) -> DataFrame:
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"])
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(said("user").alias("question"), said("assistant").alias("answer"))
    n = F.least(F.size("question"), F.size("answer"))
    past = F.arrays_zip(F.slice("question", 1, n).alias("question"), F.slice("answer", 1, n).alias("answer"))
    card = F.array(F.struct(F.concat(F.lit("pr:"), F.col("conv_id").cast("string")).alias("id"), F.lit("PR").alias("title"), F.lit("x").alias("text")))
    return talks.select("conv_id", F.sha2(cd.user_message(F.lit("why"), card, past), 256).alias("message"))


@query(f"""WITH {P}, j AS (SELECT *, CASE WHEN label = 1 THEN CASE WHEN score >= 0.5 THEN 'true positive' ELSE 'false negative' END ELSE CASE WHEN score >= 0.5 THEN 'false positive' ELSE 'true negative' END END AS o FROM p)
SELECT split, sample_id, sample_id || ': label ' || label || ', risk ' || format('{{:.3f}}', score) || CASE WHEN score >= 0.5 THEN ', risky (' ELSE ', not risky (' END || o || ')' AS line FROM j UNION ALL
SELECT split, NULL, 'Totals: true positive ' || count(*) FILTER (o = 'true positive') || ', false positive ' || count(*) FILTER (o = 'false positive') || ', true negative ' || count(*) FILTER (o = 'true negative') || ', false negative ' || count(*) FILTER (o = 'false negative') || '.' FROM j GROUP BY 1""")
def xr21_prediction_lines(spark: SparkSession, d: str) -> DataFrame:
    return cd.prediction_lines(v.predictions(spark, d), F.lit(0.5))


def all_cards(spark: SparkSession, d: str) -> DataFrame:
    card = lambda t, kind, key, title: table(spark, d, t).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(title).cast("string").alias("title"))
    return cd.deck(card("orders", "pr", "o_orderkey", "o_orderpriority"), card("supplier", "module", "s_suppkey", "s_name"), card("customer", "repo", "c_custkey", "c_name"))


CARDS = "c AS (SELECT 'pr:' || o_orderkey AS id, 'pr' AS kind, o_orderpriority AS title FROM orders UNION ALL SELECT 'module:' || s_suppkey, 'module', s_name FROM supplier UNION ALL SELECT 'repo:' || c_custkey, 'repo', c_name FROM customer)"


@query(f"WITH {CARDS} SELECT kind, count(*) AS n FROM c GROUP BY 1")
def sx31_card_kinds(spark: SparkSession, d: str) -> DataFrame:
    cards, path = all_cards(spark, d), shared(spark, "sx31")
    store.write_jsonl(cards, path)
    return rl.counts(store.read_jsonl(spark, path, cards.schema), ["kind"])


@query(f"WITH {CARDS} SELECT * FROM c")
def sx32_deck(spark: SparkSession, d: str) -> DataFrame:
    return all_cards(spark, d)


@query(f"""WITH {PART} SELECT path, 'CALLS' AS relation, f.m || '.C' || f.k || '.run' AS source, bm || '.f' || f.b AS name FROM f JOIN p USING (k) UNION ALL SELECT path, 'CALLS', f.m || '.f' || f.k, f.m || '.C' || f.k FROM f JOIN p USING (k)
UNION ALL SELECT path, 'ACCESSES_GLOBAL', f.m || '.C' || f.k || '.run', f.m || '.X' || f.k FROM f JOIN p USING (k)""")
def sx33_predicted_triples(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    return cd.predicted_triples(edges, nodes, ["Exception", "dict", "object"]).where("relation <> 'INHERITS'")


def calls(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("l_returnflag") == "R", "lib.m").otherwise("pkg.m"), F.col("l_suppkey").cast("string"), F.lit(".f"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("program"), F.concat(F.lit("pkg.m"), F.col("l_partkey") % 4).alias("caller"), name.alias("callee"))
    return lines.groupBy("program", "caller").agg(F.collect_list("callee").alias("callees"))


def modules(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("program"), "l_partkey", "l_suppkey")
    return lines.select("program", F.explode(F.array(F.concat(F.lit("pkg.m"), F.col("l_partkey") % 4), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("pkg.m"), F.col("l_suppkey"))))).alias("module")).where("module IS NOT NULL").distinct()


GOLD = """g AS (SELECT l_orderkey AS program, 'pkg.m' || l_partkey % 4 AS caller, CASE WHEN l_returnflag = 'R' THEN 'lib.m' ELSE 'pkg.m' END || l_suppkey AS m FROM lineitem),
k AS (SELECT DISTINCT l_orderkey AS program, unnest(['pkg.m' || l_partkey % 4, CASE WHEN l_suppkey % 2 = 0 THEN 'pkg.m' || l_suppkey END]) AS module FROM lineitem),
e AS (SELECT program, caller, m || '.f' AS callee, EXISTS (SELECT 1 FROM k WHERE k.program = g.program AND k.module = g.m) AS inner_ FROM g)"""


@query(f"WITH {GOLD} SELECT program, caller, callee, inner_ AS inner FROM e")
def sx34_gold_edges(spark: SparkSession, d: str) -> DataFrame:
    return cd.gold_edges(calls(spark, d), modules(spark, d), "program")


@query(f"""WITH {GOLD}, i AS (SELECT DISTINCT program, caller, callee FROM e WHERE inner_) SELECT program, count(*) FILTER (hash_ok) AS tp, 0 AS fp, count(*) FILTER (NOT hash_ok) AS fn FROM (SELECT *, length(callee) % 2 = 0 AS hash_ok FROM i) GROUP BY 1
UNION ALL SELECT NULL, count(*) FILTER (length(callee) % 2 = 0), 0, count(*) FILTER (length(callee) % 2 = 1) FROM i""")
def sx35_by_program(spark: SparkSession, d: str) -> DataFrame:
    gold = cd.gold_edges(calls(spark, d), modules(spark, d), "program").where("inner").drop("inner")
    return ev.set_scores(gold.where(F.length("callee") % 2 == 0), gold, ["caller", "callee"], ["program"]).select("program", "tp", F.col("fp").cast("int").alias("fp"), "fn")


@query(f"""WITH {E}, a AS (SELECT DISTINCT relation, src, dst FROM edges WHERE year = 1996), b AS (SELECT DISTINCT relation, src, dst FROM edges WHERE year = 1997), s AS (SELECT relation, src AS m FROM b UNION SELECT relation, dst FROM b),
f AS (SELECT relation, src, dst FROM a WHERE (relation, src) IN (SELECT relation, m FROM s) AND (relation, dst) IN (SELECT relation, m FROM s)),
j AS (SELECT 'all' AS part, coalesce(a.relation, b.relation) AS relation, a.src IS NOT NULL AS x, b.src IS NOT NULL AS y FROM a FULL JOIN b ON a.relation = b.relation AND a.src = b.src AND a.dst = b.dst
UNION ALL SELECT 'shared', coalesce(f.relation, b.relation), f.src IS NOT NULL, b.src IS NOT NULL FROM f FULL JOIN b ON f.relation = b.relation AND f.src = b.src AND f.dst = b.dst)
SELECT part, relation, count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (y AND NOT x) AS fn FROM j GROUP BY GROUPING SETS ((part, relation), (part))""")
def sx36_all_and_shared(spark: SparkSession, d: str) -> DataFrame:
    a, b = (v.edges(spark, d, y) for y in (1996, 1997))
    scanned = b.select("relation", F.explode(F.array("src", "dst")).alias("module"))
    scores = lambda found, part: ev.set_scores(found, b, ["src", "dst"], ["relation"]).select(F.lit(part).alias("part"), "relation", "tp", "fp", "fn")
    return scores(a, "all").unionByName(scores(cd.shared_only(a, scanned, "relation", ["src", "dst"]), "shared"))


@query("""SELECT c_custkey AS repo, CASE WHEN c_custkey % 3 = 0 THEN 'src' ELSE '.' END AS root, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey ELSE 'a,c' || c_nationkey END AS packages FROM customer""")
def sx37_source_layout(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    top = [F.lit("a/__init__.py"), F.lit("tests/__init__.py"), F.lit("a/b/c/__init__.py"), F.lit("not-one/__init__.py"), F.concat(F.lit("c"), n, F.lit("/__init__.py")), F.lit("src/setup.py")]
    inner = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("src/b"), k, F.lit("/__init__.py")))
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.explode(F.array(*top, inner)).alias("path")).where("path IS NOT NULL")
    return cd.source_layout(files).withColumn("packages", F.array_join("packages", ","))


@query(f"WITH {E} SELECT src, dst, relation, EXISTS (SELECT 1 FROM edges b WHERE b.year = 1995 AND b.src = a.src AND b.dst = a.dst AND b.relation = a.relation) AS known FROM edges a WHERE year = 1996")
def sx46_context(spark: SparkSession, d: str) -> DataFrame:
    return cd.context(v.edges(spark, d, 1995), v.edges(spark, d, 1996), ["src", "dst", "relation"])


@query(f"""WITH {P} SELECT sample_id, '#' || sample_id || ' · ' || split || CASE WHEN label = 1 THEN ' · risky' ELSE ' · safe' END || ' · risk ' || format('{{:.3f}}', score) ||
CASE WHEN (score >= 0.5)::INT = label THEN ' · correct' ELSE ' · WRONG' END || CASE WHEN sample_id % 3 = 0 THEN ' · explained' ELSE '' END AS title FROM p""")
def sx47_pr_label(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sample_id")
    return v.predictions(spark, d).select("sample_id", cd.pr_label(s, F.col("split"), F.col("label"), F.col("score"), F.lit(0.5), s % 3 == 0).alias("title"))


@query("""WITH x AS (SELECT p_partkey AS k, unnest(['Base', 'Structure', 'Diff']) AS part, unnest([p_size - 20, p_partkey % 9 - 4, 0]) / 4.0::DOUBLE AS v FROM part) SELECT k, part, round(v, 3) AS logit, CASE WHEN v >= 0 THEN 'pushes risk up' ELSE 'pushes risk down' END AS direction FROM x""")
def sx47_layer_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("k"), ((F.col("p_size") - 20) / 4.0).alias("base"), ((k % 9 - 4) / 4.0).alias("structure"), F.lit(0.0).alias("diff"))
    return cd.layer_a(rows, "k", {"base": "Base", "structure": "Structure", "diff": "Diff"})


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS n FROM events WHERE event_id % 3 > 0 AND event_id % 5 > 0")
def sx48_valid_documents(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    inner = F.concat(F.lit('{"schema": "'), F.when(i % 5 > 0, "v5").otherwise("v4"), F.lit('", '), F.substr("props", F.lit(2)))
    return cd.valid_documents(e.select("event_id", F.when(i % 3 > 0, inner).otherwise("{broken").alias("value")), "value", "k long", "v5").select("event_id", F.col("doc.k").alias("n"))


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS n FROM part), y AS (SELECT k, CASE WHEN k % 4 > 0 THEN 'Title: t' || k || chr(10) ELSE '' END AS a,
'The model''s risk score is ' || format('{:.4f}', n / 100.0::DOUBLE) || ' (threshold 0.2500), so it ' || CASE WHEN n >= 25 THEN 'flags it as likely to increase coupling.' ELSE 'does not flag it.' END AS b,
CASE WHEN k % 3 = 0 THEN '' ELSE chr(10) || 'Dependencies with the most influence on the score (+ pushes risk up, - pushes it down):' || chr(10) || '  - m' || k || ' CALLS n (+0.500)' || CASE WHEN k % 3 = 2 THEN chr(10) || '  - n IMPORTS o (-0.250)' || chr(10) || '  - o CALLS p (+0.125)' ELSE '' END END AS c FROM x)
SELECT k, a || b || c AS evidence FROM y""")
def sx52_evidence(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 4 > 0, F.concat(F.lit("PR: t"), k.cast("string"), F.lit(". "))).otherwise("")
    first, more = F.concat(F.lit(" Edges: a.py:m"), k.cast("string"), F.lit(" -> CALLS -> n (0.5)")), F.lit("; b.py:n -> IMPORTS -> o (-0.25); o -> CALLS -> c.py:p (0.125); p -> CALLS -> q (9.0)")
    text = F.concat(name, F.lit("Risk score "), F.format_string("%.2f", n / 100.0), F.lit(" (threshold 0.25)."), F.when(k % 3 == 0, "").when(k % 3 == 1, first).otherwise(F.concat(first, more)))
    return table(spark, d, "part").select(k.alias("k"), cd.evidence_text(text).alias("evidence"))


@query("""WITH a AS (SELECT o_orderkey AS sample_id, unnest(['signature', 'text', 'none']) AS mode, unnest(['x', CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'y' END, 'z']) AS explanation FROM orders),
w AS (SELECT sample_id FROM a WHERE trim(explanation) <> '' GROUP BY 1 HAVING count(*) = 3 ORDER BY sha256('s:' || sample_id), 1 LIMIT 12)
SELECT sample_id, chr(64 + row_number() OVER (PARTITION BY sample_id ORDER BY sha256('s:' || sample_id || ':' || mode), mode)::INT) AS letter, mode, explanation FROM a WHERE sample_id IN (SELECT * FROM w)""")
def sx52_blind_survey(spark: SparkSession, d: str) -> DataFrame:
    modes = ["signature", "text", "none"]
    said = F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in modes]), F.array(F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("y"), F.lit("z")))).alias("mode", "explanation")
    return cd.blind_survey(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), said), modes, 12, "s")


NAMED = "r AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'validation' WHEN doc_id % 41 = 0 THEN 'test' ELSE 'train' END AS split, quality AS label FROM labels)"


@query(f"""WITH {NAMED}, c AS (SELECT split, count(*) FILTER (label = 0) AS s, count(*) AS n FROM r GROUP BY 1)
SELECT split, split || ' has only ' || s || ' safe (label 0) PR(s); its scores are not reliable.' AS note FROM c WHERE s < 3 UNION ALL SELECT split, 'Only ' || n || ' test PRs: use the bootstrap ranges, not single numbers.' FROM c WHERE split = 'test' AND n < 30
UNION ALL SELECT 'test', 'Fusion does not rank test PRs better than chance (PR-AUC <= share of risky PRs).' FROM r HAVING avg(label) >= 0.01""")
def sx53_warnings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, d, "labels").select("doc_id", F.when(k % 97 == 0, "validation").when(k % 41 == 0, "test").otherwise("train").alias("split"), F.col("quality").alias("label"))
    results = rows.agg(F.avg("label").alias("ap")).select(F.lit("always").alias("name"), "ap").union(spark.createDataFrame([("model", 0.01)], "name string, ap double"))
    return cd.warnings(rows.select("split", "label"), results, "model", "always")


@query("""WITH x AS (SELECT o_orderkey AS k, count(l_partkey) FILTER (l_returnflag = 'R') AS n, count(DISTINCT l_suppkey) FILTER (l_suppkey % 3 = 0) AS t FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT k, CASE WHEN n = 0 THEN 'no production Python change' WHEN k % 7 IN (0, 1) THEN 'no later snapshot for the outcome window' WHEN t = 0 THEN 'changed files are not analysed project modules' WHEN k % 5 = 0 THEN 'no shared modules' END AS reason FROM x""")
def lb13_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("files"), F.collect_set(F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey"))).alias("touched"))
    future = F.when(k % 7 == 0, None).when(k % 7 == 1, k).otherwise(k + 1)
    reason = cd.skip_reason(F.col("files"), future, k, F.col("touched"), F.lit("no shared modules"), F.when(k % 5 > 0, k % 2))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select(k.alias("k"), reason.alias("reason"))


@query("""WITH p AS (SELECT label AS k, vec_id % 5 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT k, i, sum(w * x) / sum(w) AS m FROM p GROUP BY 1, 2)
SELECT k, i - 1 AS i, round(m, 6) AS m FROM m""")
def fe15_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    windows = table(spark, d, "embeddings").select(F.col("label").alias("k"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 5 + 1).alias("w"))
    return cd.weighted_mean(windows, "k", "vector", "w").select("k", F.posexplode("vector").alias("i", "m")).withColumns({"i": F.col("i").cast("long"), "m": F.round("m", 6)})


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, round(1 / (1 + exp(-(0.25 + (ln(1 + l_quantity) - 3) / 2 * 0.5 - (ln(1 + l_suppkey) - 1) / 4))), 6) AS score FROM lineitem")
def ml12_given_model(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.array("l_quantity", F.col("l_suppkey").cast("double")).alias("f"))
    return cd.scored(rows, "f", [(3.0, 2.0), (1.0, 4.0)], [0.5, -1.0], 0.25).select("k", "n", "p", F.round("score", 6).alias("score"))


@query("""SELECT * FROM (SELECT vec_id, CASE WHEN vec_id % 13 = 0 AND vec_id % 7 > 0 THEN 'missing' WHEN vec_id % 13 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 'surplus' WHEN vec_id % 11 = 0 THEN 'width' WHEN vec_id % 17 = 0 THEN 'not finite' END AS problem FROM embeddings) WHERE problem IS NOT NULL""")
def ml14_export_problems(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("vec_id"), table(spark, d, "embeddings")
    vector = F.when(k % 11 == 0, F.array(F.lit(1.0))).when(k % 17 == 0, F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    samples = e.select("vec_id", F.when(k % 7 == 0, "purged").otherwise("train").alias("split"))
    return cd.export_problems(e.where(k % 13 > 0).select("vec_id", vector.alias("vector")), samples, "vec_id", "vector", 2)


@query("SELECT t AS artefact, n * (SELECT count(*) FROM part) + x AS n FROM (VALUES ('nodes', 5, 5), ('edges', 9, 0), ('features', 5, 5)) v(t, n, x)")
def sx01_analysis(spark: SparkSession, d: str) -> DataFrame:
    done = rs.write_analysis(rs.with_modules(sources(spark, d)), shared(spark, "sx01"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artefact"), "n") for name, df in done.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"""WITH {E}, a AS (SELECT src, dst, relation FROM edges WHERE year = 1996), b AS (SELECT src, dst, relation FROM edges WHERE year = 1995)
SELECT (SELECT count(*) FROM a) AS edges, (SELECT count(*) FROM a WHERE src % 3 = 0 OR dst % 3 = 0) AS touched, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS added, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS removed""")
def sx03_written_graph(spark: SparkSession, d: str) -> DataFrame:
    touched = v.modules(spark, d).where("module % 3 = 0").select(F.col("module").alias("node"))
    return rl.write_graph(v.edges(spark, d, 1995), v.edges(spark, d, 1996), ["src", "dst", "relation"], touched, shared(spark, "sx03"))["metrics"]
