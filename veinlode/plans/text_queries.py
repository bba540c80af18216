"""Queries of the filters, text predicates, scalar functions, features and retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import features as fe
from ..operators import retrieval as rt
from ..sources.store import cut_sections, table
from .registry import query

KEYWORDS = ["the", "of and", "cardinal", "la"]


@query("""SELECT doc_id, coalesce(lower(trim(source)) IN ('src0', 'src7') OR lower(trim(source)) LIKE '%9', false) AS automated, n_chars >= 800 AS impact FROM documents""")
def fl01_automation_impact(spark: SparkSession, d: str) -> DataFrame:
    author = F.when(F.col("source").endswith("9"), F.concat("source", F.lit("[bot]"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", c.is_automated(author, ["src0", "src7"]).alias("automated"), c.passes_impact(F.col("n_chars"), 800).alias("impact"))


SEARCH = r"regexp_matches(lower(text), '(^|[^\w-]){0}($|[^\w-])')"


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {SEARCH.format(k)} THEN '{k}' END" for k in KEYWORDS)}], lambda x: x IS NOT NULL), ',') AS matched FROM documents""")
def fl03_semantic_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", c.matched_keywords(F.col("text"), KEYWORDS)).alias("matched"))


@query(r"""SELECT page_id, length(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g')) AS n FROM pages""")
def fl04_without_blocks(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("html", "(?i)<(/?)script", "<$1details"), "^$", "")
    kept = c.without_details(text)
    return table(spark, d, "pages").select("page_id", F.length(kept).alias("n"))


STATUS = f"""CASE WHEN source = 'src3' THEN 'rejected_automation' WHEN n_chars < 800 OR n_chars IS NULL THEN 'rejected_impact'
WHEN NOT ({' OR '.join(SEARCH.format(k) for k in KEYWORDS[1:3])}) THEN 'rejected_semantic' ELSE 'accepted' END"""


def decided(spark: SparkSession, d: str) -> DataFrame:
    hit = F.size(c.matched_keywords(F.col("text"), KEYWORDS[1:3])) > 0
    status = (
        F.when(c.is_automated(F.col("source"), ["src3"]), "rejected_automation")
        .when(~c.passes_impact(F.col("n_chars"), 800), "rejected_impact")
        .when(~hit, "rejected_semantic")
        .otherwise("accepted")
    )
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", status.alias("filter_status"))


@query(f"SELECT doc_id, {STATUS} AS filter_status FROM documents")
def fl06_evaluate_record(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).select("doc_id", "filter_status")


@query(f"SELECT doc_id FROM documents WHERE {STATUS} = 'accepted'")
def fl07_accepted(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).where("filter_status = 'accepted'").select("doc_id")


@query(f"""SELECT filter_status, count(*) AS n, count(DISTINCT source) AS repos, round(avg(n_chars), 6) AS mean, median(n_chars) AS median
FROM (SELECT *, {STATUS} AS filter_status FROM documents) GROUP BY 1""")
def fl08_filter_statistics(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).groupBy("filter_status").agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("repos"), F.round(F.avg("n_chars"), 6).alias("mean"), F.percentile("n_chars", 0.5).alias("median")
    )


PATH = "replace(lower(p_type), ' ', '/') || CASE WHEN p_size % 5 = 0 THEN '/docs' ELSE '' END || '/' || CASE WHEN p_size % 7 = 0 THEN 'test_' WHEN p_size % 11 = 0 THEN 'setup' ELSE 'f' END || CASE WHEN p_size % 11 = 0 AND p_size % 7 <> 0 THEN '' ELSE p_partkey::VARCHAR END || CASE WHEN p_size % 3 = 0 THEN '.txt' ELSE '.py' END"


@query(f"""WITH x AS (SELECT p_partkey, {PATH} AS path FROM part), s AS (SELECT *, string_split(path, '/') AS p FROM x)
SELECT p_partkey, path, p[-1] LIKE '%.py' AND p[-1] NOT IN ('setup.py', 'conftest.py') AND NOT list_has_any(p[:-2], ['docs', 'doc', 'examples', 'build', 'dist', 'env'])
AND NOT list_bool_or(list_transform(p, lambda v: v IN ('test', 'tests') OR v LIKE 'test\\_%' ESCAPE '\\')) AS production FROM s""".replace("\\\\", "\\"))
def fl10_production_files(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 7 == 0, "test_").when(size % 11 == 0, "setup").otherwise("f")
    number = F.when((size % 11 == 0) & (size % 7 != 0), "").otherwise(F.col("p_partkey").cast("string"))
    path = F.concat(F.translate(F.lower("p_type"), " ", "/"), F.when(size % 5 == 0, "/docs").otherwise(""), F.lit("/"), name, number, F.when(size % 3 == 0, ".txt").otherwise(".py"))
    return table(spark, d, "part").select("p_partkey", path.alias("path")).withColumn("production", c.is_production_python(F.col("path")))


@query("""SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 AND contains(lower(source || ' ' || lang), '1') ORDER BY n_chars DESC""")
def fl14_attribution_filter(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains(F.lower(F.concat_ws(" ", "source", "lang")), F.lit("1"))
    return table(spark, d, "documents").where((F.col("lang") == "en") & (F.col("n_chars") > 500) & hit).select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([a-z0-9.-]+)/([a-z]{2})/(\d+)', 1) AS owner, regexp_extract(url, '^https?://([a-z0-9.-]+)/([a-z]{2})/(\d+)', 2) AS name,
try_cast(nullif(regexp_extract(url, '^https?://([a-z0-9.-]+)/([a-z]{2})/(\d+)', 3), '') AS BIGINT) AS number FROM pages""")
def fl16_parse_url(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract("url", r"^https?://([a-z0-9.-]+)/([a-z]{2})/(\d+)", i)
    return table(spark, d, "pages").select("page_id", part(1).alias("owner"), part(2).alias("name"), F.expr("try_cast(nullif(x, '') AS BIGINT)".replace("x", "regexp_extract(url, r'^https?://([a-z0-9.-]+)/([a-z]{2})/(\\d+)', 3)")).alias("number"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def sf03_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", c.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 6 MONTH AS horizon, last_day(o_orderdate) + INTERVAL '23:59:59' AS month_end, date_trunc('month', o_orderdate) AS month_start,
round(epoch(o_orderdate) / 86400 / 365.25::DOUBLE, 6) AS years FROM orders""")
def sf07_time(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", c.add_months(at, 6).alias("horizon"), c.month_end(at.cast("timestamp")).cast("timestamp_ntz").alias("month_end"),
        F.date_trunc("month", at).cast("timestamp_ntz").alias("month_start"), F.round(F.unix_timestamp(at.cast("timestamp")) / 86400 / 365.25, 6).alias("years"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 5)), 6) AS p, round(ln(greatest(least(l_discount, 1 - 1e-6), 1e-6) / (1 - greatest(least(l_discount, 1 - 1e-6), 1e-6))), 6) AS logit,
round(ln(1 + l_extendedprice), 6) AS log_price, CASE WHEN l_tax + l_discount > 0 THEN round(l_tax / (l_tax + l_discount), 6) ELSE 0 END AS instability FROM lineitem""")
def sf10_numeric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(c.sigmoid((F.col("l_quantity") - 25) / 5), 6).alias("p"), F.round(c.logit(F.col("l_discount")), 6).alias("logit"),
        F.round(F.log1p("l_extendedprice"), 6).alias("log_price"), F.round(c.instability(F.col("l_discount"), F.col("l_tax")), 6).alias("instability"),
    )


@query("SELECT doc_id, sha256(text) AS sha, format('{:.3f}', n_chars / 7.0::DOUBLE) AS shown FROM documents")
def sf15_hash_and_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.format_string("%.3f", F.col("n_chars") / 7.0).alias("shown"))


@query("""SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value, len(json_keys(props)) AS n FROM events""")
def sf17_json(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.map_values(m)[0].alias("first_value"), F.size(m).alias("n"))


DIFF = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || '+') ELSE replace(text, chr(10), chr(10) || '-') END"


def diffs(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n+"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\n-")))
    return table(spark, d, "documents").select("doc_id", "lang", text.alias("diff"))


@query(f"""WITH x AS (SELECT doc_id, string_split({DIFF}, chr(10)) AS l FROM documents)
SELECT doc_id, round(ln(1 + len(list_filter(l, lambda v: v LIKE '+%' AND v NOT LIKE '+++%'))), 6) AS added, round(ln(1 + len(list_filter(l, lambda v: v LIKE '-%' AND v NOT LIKE '---%'))), 6) AS removed FROM x""")
def fe03_change_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = fe.change_sizes(F.col("diff"))
    return diffs(spark, d).select("doc_id", F.round(sizes["added"], 6).alias("added"), F.round(sizes["removed"], 6).alias("removed"))


@query(f"""WITH x AS (SELECT doc_id, unnest(string_split({DIFF}, chr(10))) AS v FROM documents), k AS (SELECT doc_id, v FROM x WHERE (v LIKE '+%' AND v NOT LIKE '+++%') OR (v LIKE '-%' AND v NOT LIKE '---%')),
t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(v, '[A-Za-z_][A-Za-z0-9_]*'), lambda n: CASE WHEN v LIKE '+%' THEN 'A_' ELSE 'R_' END || n)) AS token FROM k)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY token""")
def fe05_diff_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = diffs(spark, d).select("doc_id", F.explode(fe.diff_tokens(F.col("diff"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""WITH t AS (SELECT doc_id, lang = 'en' AS train, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents),
f AS (SELECT doc_id, token, count(*) AS tf, bool_or(train) AS train FROM t GROUP BY 1, 2), v AS (SELECT token, count(*) AS df, sum(tf) AS a FROM f WHERE train GROUP BY 1 HAVING count(*) >= 3 ORDER BY a DESC, token LIMIT 20000),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t WHERE train), w AS (SELECT doc_id, token, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM f JOIN v USING (token), n)
SELECT doc_id, count(*) AS terms, round(max(w / s), 6) AS heaviest FROM w JOIN (SELECT doc_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1) USING (doc_id) GROUP BY doc_id""")
def fe06_tfidf(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("train"), F.explode(c.words(F.col("text"))).alias("token"))
    return fe.tfidf(t, "doc_id", "token", F.col("train"), 3, 20000).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("heaviest"))


@query("""WITH s AS (SELECT avg(ln(1 + n_chars)) AS m, greatest(stddev_pop(ln(1 + n_chars)), 1e-6) AS s FROM documents WHERE lang = 'en') SELECT doc_id, round((ln(1 + n_chars) - m) / s, 6) AS n_chars FROM documents, s""")
def fe07_scaler(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    scaled = fe.apply_scaler(docs, fe.fit_scaler(docs.where("lang = 'en'"), ["n_chars"]), ["n_chars"])
    return scaled.select("doc_id", F.round("n_chars", 6).alias("n_chars"))


@query("SELECT quality, round(n / (2.0::DOUBLE * k), 9) AS weight FROM (SELECT quality, count(*) AS k FROM labels GROUP BY 1), (SELECT count(*) AS n FROM labels)")
def sx11_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return fe.class_weights(table(spark, d, "labels"), "quality").select("quality", F.round("weight", 9).alias("weight"))


def bm25_sql(k1: float, stop: bool, distinct: bool, k: int) -> str:
    toks = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
    if stop:
        toks = f"list_filter({toks}, lambda w: w NOT IN ({', '.join(repr(s) for s in rt.STOPWORDS)}))"
    return f"""WITH c AS (SELECT doc_id, {toks} AS t FROM documents), s AS (SELECT count(*) AS n, sum(len(t))::DOUBLE / count(*) AS m FROM c),
u AS (SELECT doc_id, len(t) AS len, unnest(t) AS w FROM c), f AS (SELECT doc_id, len, w, count(*) AS tf FROM u GROUP BY ALL), d AS (SELECT w, count(*) AS df FROM f GROUP BY 1),
q AS (SELECT item_id, w, count(*) AS qn FROM (SELECT item_id, unnest({toks}) AS w FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum({'1' if distinct else 'qn'} * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / m))) AS score
      FROM q JOIN f USING (w) JOIN d USING (w), s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= {k}"""


@query(bm25_sql(1.2, False, True, 3))
def xr12_bm25(spark: SparkSession, d: str) -> DataFrame:
    scored = rt.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text")
    return rt.top_k(scored, "item_id", "doc_id", 3).withColumn("score", F.round("score", 6))


@query(bm25_sql(1.5, True, False, 5))
def xr13_bm25_chat(spark: SparkSession, d: str) -> DataFrame:
    scored = rt.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", k1=1.5, stop=True, distinct=False)
    return rt.top_k(scored, "item_id", "doc_id", 5).withColumn("score", F.round("score", 6))


TAGS = "t AS (SELECT l_orderkey AS sample, p_brand AS tag, sum(l_quantity) AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), n AS (SELECT sample, tag, round(w / sum(w) OVER (PARTITION BY sample), 12) AS weight FROM t)"


def tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rt.normalised_weights(rows.select(F.col("l_orderkey").alias("sample"), F.col("p_brand").alias("tag"), F.col("l_quantity").alias("weight")))


@query(f"WITH {TAGS} SELECT sample, tag, round(weight, 9) AS weight FROM n")
def xr11_signature(spark: SparkSession, d: str) -> DataFrame:
    return tags(spark, d).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {TAGS}, c AS (SELECT p_type AS card_id, p_brand AS tag, true AS sig FROM part WHERE p_size > 25 GROUP BY ALL UNION ALL SELECT p_type, p_brand, false FROM part WHERE p_size <= 25 GROUP BY ALL),
s AS (SELECT sample, card_id, sum(CASE WHEN sig THEN weight ELSE 0.03::DOUBLE END) AS score FROM n JOIN c USING (tag) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(score, 9) DESC, card_id) AS rank FROM s) SELECT sample, card_id, round(score, 6) AS score, rank FROM k WHERE rank <= 2""")
def xr14_by_signature(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "part").groupBy(F.col("p_type").alias("card_id")).agg(
        F.collect_set(F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("graph_signals"), F.collect_set(F.when(F.col("p_size") <= 25, F.col("p_brand"))).alias("relations")
    )
    return rt.by_signature(tags(spark, d), cards, 2).withColumn("score", F.round("score", 6))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, '\d+'))), ',') AS numbers FROM pages""")
def xr17_mentions(spark: SparkSession, d: str) -> DataFrame:
    hashed = F.regexp_replace("url", r"(\d+)", "#$1")
    return table(spark, d, "pages").select("page_id", F.concat_ws(",", F.array_sort(rt.mentioned_numbers(hashed))).alias("numbers"))


@query(r"""WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '-?\d+(?:\.\d+)?')) AS n FROM documents),
x AS (SELECT doc_id, unnest(n) AS n FROM a) SELECT doc_id, count(*) AS unsupported FROM x
WHERE NOT (abs(1 - n::DOUBLE) <= 0.5 / 10.0 ** length(regexp_extract(n, '\.(\d+)$', 1)) + 1e-12 OR abs(62.5 - n::DOUBLE) <= 0.5 / 10.0 ** length(regexp_extract(n, '\.(\d+)$', 1)) + 1e-12) GROUP BY 1""")
def xr18_violations(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(F.lit(1.0), F.lit(62.5))
    found = table(spark, d, "documents").select("doc_id", F.size(rt.unsupported(F.col("text"), values, r"-?\d+(?:\.\d+)?")).cast("long").alias("unsupported"))
    return found.where("unsupported > 0")


@query("""SELECT page_id AS file, count(*) AS sections FROM (SELECT page_id, unnest(string_split(html, '<p>')) AS s FROM pages) GROUP BY 1 HAVING count(*) > 1""")
def io23_sections(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "pages").select(F.col("page_id").alias("file"), F.replace(F.replace("html", F.lit("\n"), F.lit(" ")), F.lit("<p>"), F.lit("\n## ")).alias("value"))
    n = cut_sections(text).groupBy("file").agg((F.count("*") + 1).alias("sections"))
    return n


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4""")
def wn14_last_turns(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.temporal import ranked_cut

    return ranked_cut(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn", "role")


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_type), ' '))), ' ') AS parts, list_has_any(string_split(p_type, ' '), ['SMALL', 'LARGE']) AS sized FROM part""")
def sf16_arrays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.concat_ws(" ", F.array_sort(F.array_distinct(F.split(F.lower("p_type"), " ")))).alias("parts"),
        F.arrays_overlap(F.split("p_type", " "), F.array(F.lit("SMALL"), F.lit("LARGE"))).alias("sized"),
    )


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS merged, count(*) FILTER (o_orderstatus = 'O') AS open, bool_or(o_totalprice > 400000) AS any_large, bool_and(o_totalprice > 1000) AS all_real FROM orders GROUP BY 1""")
def ag02_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_if(s == "F").alias("merged"), F.count_if(s == "O").alias("open"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_real")
    )


@query("""SELECT o_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS card FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def ag15_text_cards(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return lines.groupBy("o_orderkey").agg(F.concat_ws(" ", F.transform(parts, lambda p: F.concat_ws(":", p["l_linenumber"], p["l_returnflag"]))).alias("card"))
