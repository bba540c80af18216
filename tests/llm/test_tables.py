"""Links, preferences, the pipeline and its SQL twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from veinlode.llm import links, preferences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_preferences", "op5_decontaminate", "op7_rules", "op8_neardup"])
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in cur.fetchall())


def test_rules_judge_urls(spark):
    urls = [
        "http://x.example.COM/en/12?q", "https://example.com/en/71", "http://a.example.net/de/81#x", "http://b.net/de/1", "ftp://q.org/es/", "http://com/en/x",
        "http://notcom/en/", None, "", "no scheme", "http://h?x://y/z", "http://a.org/fr/1",
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], "<a href=x>")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in links.digest(df).collect()}
    assert got[0] == ("x.example.com", "/en/12", "com/en/", "block")
    assert got[1] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2] == ("a.example.net", "/de/81", "example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "block") and got[4][2:] == ("org/es/", "block") and got[5][2:] == ("com/en/", "block")
    assert got[6] == ("notcom", "/en/", None, "allow")
    assert [got[i][:2] for i in (7, 8, 9)] == [("", "")] * 3
    assert got[10][:2] == ("h", "") and got[11][3] == "allow"
    assert links.digest(df).count() == len(urls) + 1
    assert links.digest(df.limit(0)).count() == 0


def plain_rank(edges, seeds, rounds, damping):
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    rank = dict(start)
    for _ in range(rounds):
        new = {h: (1 - damping) * s for h, s in start.items()}
        for (a, b), n in edges.items():
            out = sum(m for (x, _), m in edges.items() if x == a)
            if a in rank:
                new[b] = new.get(b, 0) + damping * rank[a] * n / out
        rank = new
    return rank


def test_propagation_is_personalised_pagerank(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 1, ("d", "c"): 3}
    e = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 2.0), ("trust", "d", 1.0), ("distrust", "c", 1.0)], "kind string, host string, weight double")
    got = {r.host: (r.trust, r.distrust) for r in links.propagate(e, seeds, rounds=6).collect()}
    trust = plain_rank(edges, {"a": 2.0, "d": 1.0}, 6, 0.85)
    distrust = plain_rank({(b, a): n for (a, b), n in edges.items()}, {"c": 1.0}, 6, 0.85)
    for host in set(trust) | set(distrust):
        assert got[host] == pytest.approx((trust.get(host, 0), distrust.get(host, 0)))


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    rows = [(1, "http://spam.xyz/a", ""), (2, "http://fan.xyz/b", '<a href="http://spam.xyz/a">x</a>'), (3, "http://good.xyz/c", '<a href="//fine.xyz/">y</a>')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in links.judge(df, [], trusted=["good.xyz"], blocked=["spam.xyz"]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_seeds_are_shares_of_pages(spark):
    half = [(f"http://h{k}.xyz/{part}/{i}", "") for k in range(2) for part in ("bad", "free") for i in range(5)]
    rows = [*half, ("http://sub.h0.xyz/1", ""), ("http://fan.xyz/1", '<a href="//h1.xyz/">x</a>')]
    rows += [(f"http://mixed.xyz/{p}", "") for p in ("bad/1", "good/1", "good/2", "free/1")] + [(f"http://plain{i}.xyz/", "") for i in range(9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {(r.host, r.rule): r.verdict for r in links.judge(df, [("xyz", "/bad/", "block"), ("xyz", "/good/", "allow")]).collect()}
    assert all(got[h, None] == "block" for h in ("h0.xyz", "h1.xyz", "sub.h0.xyz", "fan.xyz"))
    assert got["mixed.xyz", None] == got["plain0.xyz", None] == "allow"
    assert got["mixed.xyz", "xyz/bad/"] == "block"


def test_preferences(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "other"),
        (3, 0, None, None), (4, 0, "assistant", "alone"), (None, 0, "user", "x"), (5, 0, "user", "hi"), (5, 1, "assistant", "hello"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    got = {r.conv_id: r for r in preferences.digest(df).collect()}
    assert len(got) == 6
    assert got[2].chosen_id == 1 and got[2].prompt_turns == 2
    assert got[2].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert got[2].chosen_text == "<|user|>\nmore<|end|>\n<|assistant|>\nlong answer<|end|>\n"
    s, e = map(int, got[2].chosen_spans.split(":"))
    assert got[2].chosen_text[s:e] == "long answer<|end|>\n"
    assert got[2].rejected_spans == "" and got[5].rejected_text == ""
    assert got[1].rejected_text is None and got[1].prompt_turns == 3
    assert got[3].prompt_turns == 0 and got[4].prompt == ""
    assert preferences.digest(df.limit(0)).count() == 0


def test_preferences_with_a_hot_first_turn_and_hard_rows(spark):
    long_text = "word " * 40_000
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", "hi" if t == 0 else f"{i} {t}") for i in range(3000) for t in range(2 + i % 2)]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, None, None, None), (9001, 0, "user", long_text), (9002, 0, "user", long_text), (9002, 1, "assistant", None)]
    rows += [(9003, 0, "user", "tie"), (9004, 0, "user", "tie"), (9005, 1, "user", "twice"), (9005, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preferences.digest(df).collect()
    assert len(got) == 3000 + 3 + 5
    hot = [r for r in got if r.conv_id is not None and r.conv_id < 9000]
    best = min((i for i in range(1, 3000, 2)), key=lambda i: (-len(f"{i} 1{i} 2"), i))
    assert {r.chosen_id for r in hot} == {best} and sum(r.rejected_text is None for r in hot) == 1
    one = {r.conv_id: r for r in got}
    assert one[9001].chosen_id == 9002 and one[9001].prompt_turns == 1 and one[9001].rejected_text == ""
    assert one[9004].chosen_id == 9003 and one[9003].rejected_text is None
    assert one[9005].chosen_text == "<|user|>\ntwice<|end|>\n" and one[9005].prompt_turns == 1
    pairs = preferences.pair_up(preferences.conversations(df)).selectExpr("*", "1 AS prompt", "2 AS prompt_turns", "3 AS p", "4 AS rejected_mask")
    made = preferences.format_pairs(pairs)
    assert made.columns[:6] == ["conv_id", "chosen_id", "prompt", "prompt_turns", "p", "rejected_mask"] and "prompt_" in made.columns
    assert made.first().prompt == 1


def test_pipeline_on_hard_rows(spark, tmp_path):
    """All stages in sequence over nulls, empty and long texts, ties, repeated rows, an empty table, and against plain stages."""
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").limit(12).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [(None, good[0].text, None, None, None), (9001, None, None, None, None), (9002, "", None, "s", 0), (9003, " ".join([good[1].text] * 40), "en", None, None)]
    rows += [(9004, good[2].text, "en", "s", 1), rows[3], rows[3]]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows += [(9005, good[4].text + " " + bench.first().text, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        spark.createDataFrame(given, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        bench.write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        if not given:
            assert out == []
            continue
        ids = {r.doc_id for r in out}
        assert 9001 not in ids and 9002 not in ids and 9005 not in ids
        assert not {9004, good[2].doc_id} <= ids
        twice = [r for r in out if r.doc_id == rows[3][0]]
        assert sum(len(r.text.split()) for r in twice) <= 3 * len(rows[3][1].split())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, seen = {r.doc_id for r in docs.collect()}, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        now = {r.doc_id for r in docs.collect()}
        assert now <= (ids if seen is None else seen)
        seen = now
        if name == "neardup":
            assert docs.count() == len(now)
    rows = docs.collect()
    for s in {r["shard"] for r in rows}:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
