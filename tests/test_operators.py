"""Literals and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from veinlode.functions import columns as c
from veinlode.operators import evaluation as ev
from veinlode.operators import graph as g
from veinlode.operators import labels as lb
from veinlode.operators import resolution as rs
from veinlode.operators import temporal as t
from veinlode.sources import python_source as ps
from veinlode.sources import store


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_triangle_density(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    row = g.density(m, edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])).first()
    assert (row.n, row.m, row.density) == (3, 3, 0.5)


def test_imports_give_coupling_and_cycle(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "a")])
    found = {r.module: (r.ca, r.ce) for r in g.coupling(m, e).collect()}
    assert found["a"] == (2, 1)
    assert g.density(m, e).first().mean_coupling == 2
    assert {r.module for r in g.cyclic(e).collect()} == {"a", "b"}


def test_both_cycle_strategies_agree(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(45)}
    e = edges(spark, sorted(pairs))
    whole = {(r.module, r.component) for r in g.cyclic(e).collect()}
    grouped = {(r.module, r.component) for r in g.cyclic_per_graph(e.withColumn("s", F.lit(1)), "s").collect()}
    assert whole == grouped and whole


def test_closure_and_reach(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(6)], "sha long, parent long")
    assert g.closure(chain).count() == 21
    near = g.reach(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]), spark.createDataFrame([("a",)], "node string"), 2)
    assert {(r.node, r.hop) for r in near.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def snapshot(spark, modules, cyclic=()):
    return spark.createDataFrame([("s", m, ca, ce, m in cyclic) for m, ca, ce in modules], "snap string, module string, ca long, ce long, in_cycle boolean")


def test_growth_label(spark):
    touched = spark.createDataFrame([(1, "s", "a")], "sample long, snap string, module string")
    at = snapshot(spark, [("a", 1, 1), ("b", 1, 1), ("c", 0, 0)])
    grown = lb.future_coupling(at, snapshot(spark, [("a", 2, 3), ("b", 1, 1), ("c", 0, 0)]), touched, 0.5).first()
    assert grown.growth == 3 and grown.trend == pytest.approx(4 / 3) and (grown.label, grown.reason) == (1, "excess_coupling_growth")
    two = snapshot(spark, [("a", 1, 1), ("b", 1, 1)])
    even = lb.future_coupling(two, snapshot(spark, [("a", 2, 2), ("b", 2, 2)]), touched, 0.5).first()
    assert even.excess == 0 and (even.label, even.reason) == (0, "no_degradation")
    cycle = lb.future_coupling(two, snapshot(spark, [("a", 1, 1), ("b", 1, 1)], cyclic={"a", "b"}), touched, 5.0).first()
    assert (cycle.label, cycle.reason) == (1, "joined_new_cycle")
    gone = lb.future_coupling(two, snapshot(spark, [("b", 4, 0)]), touched, 0.5).first()
    assert gone.label is None and gone.reason == "touched_modules_missing_in_future"


def test_censoring_comes_before_events(spark):
    import datetime as dt

    day = lambda y, m: dt.datetime(y, m, 1)
    frame = spark.createDataFrame
    samples = frame([(i, "r", day(2020, 1)) for i in range(8)] + [(8, "r", day(2021, 1)), (9, "q", day(2020, 1)), (10, None, day(2020, 1))], "sample_id long, repo string, at timestamp_ntz")
    events = frame([(100, "r", day(2020, 3), True), (101, "r", day(2020, 4), False), (102, "r", day(2021, 2), True)], "event_id long, repo string, event_at timestamp_ntz, reviewed boolean")
    files = frame([(i, "a.py") for i in range(11) if i != 1], "sample_id long, path string")
    windows = frame([("r", day(2019, 1), day(2021, 3))], "repo string, observed_from timestamp_ntz, observed_until timestamp_ntz")
    matches = frame(
        [(0, 100, "verified", ["a.py"]), (0, 101, "verified", ["a.py"]), (4, 100, "unrelated_lineage", None), (4, 101, "verified", ["a.py"]), (5, 100, "verified", []), (5, 101, "unverified_boundary", None),
         (6, 100, "verified", []), (6, 101, "unrelated_lineage", None), (7, 100, "verified", []), (8, 102, "verified", ["a.py"])],
        "sample_id long, event_id long, status string, matched array<string>",
    )
    one = lambda i: frame([(i,)], "sample_id long")
    got = {r.sample_id: (r.status, r.label) for r in lb.future_outcomes(samples, events, files, windows, matches, one(2), one(3), 6).collect()}
    assert got == {
        0: ("labelled", 1), 1: ("excluded_no_python_files", None), 2: ("excluded_non_substantive_change", None), 3: ("incomplete_sample_history", None),
        4: ("unreviewed_outcome", None), 5: ("unverified_followup_history", None), 6: ("labelled", 0), 7: ("unverified_followup_history", None),
        8: ("censored", None), 9: ("unverified_coverage", None), 10: ("invalid_metadata", None),
    }


def test_a_long_tail_loses_no_cycle(spark):
    tail = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(5)]
    e = edges(spark, [*tail, ("t05", "x"), ("x", "y"), ("y", "x")])
    assert {r.module for r in g.cyclic(e, max_rounds=3).collect()} == {"x", "y"}
    two = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")])
    with pytest.raises(RuntimeError):
        g.cyclic(two, max_rounds=1)


def test_chains_and_owners(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(6)], "sha long, parent long")
    assert {(r.sha, r.depth, r.least) for r in g.chain_facts(chain).collect()} == {(i, i, 0) for i in range(1, 7)}
    rows = [("m", None, "module", "pkg.m"), ("c", "m", "class", "x"), ("f", "c", "function", "y"), ("lost", "gone", "function", "z"), ("p", "q", "class", "p"), ("q", "p", "class", "q")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, type string, qualified_name string")
    assert {r.id: r.module for r in g.owning_modules(nodes).collect()} == {"m": "pkg.m", "c": "pkg.m", "f": "pkg.m", "lost": None, "p": None, "q": None}


def test_paths(spark):
    paths = ["pkg/a.py", "tests/test_a.py", "pkg/test_b.py", "docs/conf.py", "setup.py", "README.md", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.where(c.is_production_python(F.col("p"))).collect()] == ["pkg/a.py"]


def test_text_predicates(spark):
    df = spark.createDataFrame([("Decouple <details>x\nrefactor</details> now", "dependabot"), (None, "x[BOT]"), ("pre-refactored", None)], "t string, a string")
    got = df.select(c.has_phrase(c.without_details(F.col("t")), "refactor").alias("r"), c.has_phrase(F.col("t"), "decouple").alias("d"), c.is_automated(F.col("a")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (False, False, True), (False, False, False)]


def test_aware_time(spark):
    df = spark.createDataFrame([("2024-01-31T10:00:00Z",), ("2024-01-31T10:00:00",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(c.aware_timestamp(F.col("t")).isNotNull()).collect()]
    assert got == [True, False, False, False]


def test_average_precision_with_ties_and_auc(spark):
    rows = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.9), ("m", 1, 0.4), ("m", 0, 0.1)], "model string, label int, score double")
    assert ev.average_precision(rows, ["model"]).first().ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert ev.roc_auc(rows, ["model"]).first().auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_paired_comparison_of_two_models(spark):
    rows = lambda scores: spark.createDataFrame([(i, i % 2, float(x)) for i, x in enumerate(scores)], "id long, label int, score double")
    good, bad = rows([i % 2 for i in range(20)]), rows([1 - i % 2 for i in range(20)])
    same = ev.paired_comparison(good, good, "id", 50).first()
    assert (same.resamples, same.mean_difference, same.share_won) == (50, 0, 0)
    won, lost = ev.paired_comparison(good, bad, "id", 50).first(), ev.paired_comparison(bad, good, "id", 50).first()
    assert won.share_won == 1 and lost.share_won == 0
    assert 0.3 < won.mean_difference < 0.7 and won.mean_difference == pytest.approx(-lost.mean_difference)


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([("r", 5), ("r", 1), ("q", 9)], "k string, at int")
    right = spark.createDataFrame([("r", 2, "x"), ("r", 5, "y"), ("r", 6, "z")], "k string, at int, v string")
    assert {(r.k, r.at): r.v for r in t.as_of(left, right, "k", "at", ["v"]).collect()} == {("r", 5): "y", ("r", 1): None, ("q", 9): None}


def test_jsonl_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    for _ in range(2):
        store.append_jsonl(spark, path, rows, "id")
    assert spark.read.json(path).count() == 2
    with pytest.raises(Exception, match="without id"):
        store.append_jsonl(spark, path, spark.createDataFrame([(None, "c")], "id long, v string"), "id")


def test_strict_json_fails_and_audit_keeps(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n\nnot json\n')
    schema = spark.createDataFrame([], "id long").schema
    with pytest.raises(Exception):
        store.read_jsonl(spark, str(tmp_path / "a.json"), schema).collect()
    rows = store.read_jsonl(spark, str(tmp_path / "a.json"), schema, strict=False).collect()
    assert [(r.id, r._corrupt_record) for r in rows] == [(1, None), (None, "not json")]


def test_sections(spark):
    text = spark.createDataFrame([("f", "# top\n## One Two\nbody  x\n\n## Three\n")], "file string, value string")
    assert [(r.title, r.body, r.card_id) for r in store.cut_sections(text).orderBy("position").collect()] == [("One Two", "body x", "f-one-two"), ("Three", "", "f-three")]


SOURCE = '''
import os
from .b import helper as h
LIMIT = 3

class A(Base):
    def run(self, x):
        if x and LIMIT:
            return self.stop()
        return h(len(x))

    def stop(self):
        global LIMIT
        LIMIT = 4
'''


def test_source_graph(spark):
    files = spark.createDataFrame(
        [("s", "p/__init__.py", ""), ("s", "p/a.py", SOURCE), ("s", "p/b.py", "from .c import helper\n"), ("s", "p/c.py", "def helper(y):\n    return y\n"), ("s", "p/d.py", "def (")],
        "snapshot_id string, path string, source string",
    )
    facts = store.cut(ps.extract(rs.with_modules(files)))
    assert [r.path for r in facts.where("kind = 'error'").collect()] == ["p/d.py"]
    found = rs.nodes(facts)
    got = {(r.source, r.target, r.type) for r in rs.edges(facts, found).collect()}
    assert ("p/a.py:p.a.A.run", "p/a.py:p.a.A.stop", "CALLS") in got
    assert ("p/a.py:p.a.A.run", "p/c.py:p.c.helper", "CALLS") in got  # through the re-export
    assert ("p/a.py:p.a.A.stop", "p/a.py:p.a.LIMIT", "ACCESSES_GLOBAL") in got
    assert ("p/a.py:p.a", "p/b.py:p.b", "IMPORTS") in got
    assert ("p/a.py:p.a", "external:os", "IMPORTS") in got
    run = found.where("name = 'run'").first()
    assert run.complexity == 3


def test_signature_tags(spark):
    from veinlode.operators import signature as sg

    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    samples = df([("s", 0.2, 0.5, True)], "sample string, risk_score double, threshold double, creates_cycle boolean")
    touched = df([("s", "a")], "sample string, module string")
    modules = df([("s", "a", 1, 1, 12, 1, True), ("s", "b", 1, 0, 1, 0, False)], "sample string, module string, ca_before int, ce_before int, ca_after int, ce_after int, in_cycle boolean")
    edges = df(
        [("s", "a", "a", "IMPORTS", "b", "b", 0.5, True), ("s", "b", "b", "IMPORTS", "a", "a", 0.3, False), ("s", "x", "a", "CALLS", "y", "b", 0.2, False), ("s", "x", "a", "CALLS", "z", "a", -1.0, False)],
        "sample string, source string, source_module string, relation string, target string, target_module string, attribution double, added boolean",
    )
    nodes = df([("s", "x", "method", "a", 1.0)], "sample string, id string, type string, module string, attribution double")
    got = {r.tag: r.weight for r in sg.signature(samples, touched, modules, edges, nodes).collect()}
    raw = {"new_cycle": 0.5, "low_risk": 0.5, "import_cycle_member": 0.5, "afferent_hub": 0.5, "added_dependency": 0.5, "mutual_import": 0.8, "cross_module_call": 0.2, "feature_envy": 1.0}
    assert got == pytest.approx({k: w / sum(raw.values()) for k, w in raw.items()})


def test_grounding(spark):
    from veinlode.operators import retrieval as rt

    df = spark.createDataFrame([("0.77 of 76.9% in 3 files [pr:1] and [pr:2], not 4.5",), (None,)], "t string")
    values = F.array(F.lit(0.769))
    cards = F.array(F.lit("pr:1"))
    got = [r.asDict() for r in df.select(*[c.alias(k) for k, c in rt.check_answer(F.col("t"), cards, values).items()]).collect()]
    assert got[0] == {"citations": ["pr:1", "pr:2"], "unknown_citations": ["pr:2"], "unsupported_numbers": ["4.5"]}
    ids = spark.createDataFrame([("0.409. and v1.2.3 but 7",)], "t string").select(rt.unsupported(F.col("t"), F.array(F.lit(0.4091))).alias("u")).first().u
    assert ids == ["7"]


def test_collection_edge_cases(spark):
    from veinlode.operators import collection as co

    paths = spark.createDataFrame([("a/b.pt",), ("a/../b.pt",), ("a/../../b.pt",), ("",), ("/b.pt",), (None,), ("./b.pt",)], "p string")
    assert [r.x for r in paths.select(co.leaves_folder(F.col("p")).alias("x")).collect()] == [False, False, True, True, True, True, False]
    now = "timestamp '2024-01-01 00:00:00'"
    calls = spark.sql(f"SELECT * FROM VALUES (NULL, {now}), (11, {now}), (3, {now}), (0, NULL), (0, {now} - INTERVAL 9 SECOND), (0, {now} + INTERVAL 99 SECOND) t(r, s)")
    got = [tuple(x.w) for x in calls.select(co.wait(F.col("r"), F.col("s"), F.expr(now), 10, 20).alias("w")).collect()]
    assert got == [("go", None), ("go", None), ("low", None), ("unknown", None), ("wait", 1), ("too_long", 100)]
    records = spark.createDataFrame([("a", "s", 1, "g.pt"), ("b", "s", 1, "g.pt"), ("c", None, 1, "g.pt"), ("d", "t", 2, "g.pt"), ("e", "u", 0, "../g.pt")], "path string, sample_id string, label int, graph_path string")
    assert {r.path: r.problem for r in co.sample_problems(records).collect()} == {"b": "id", "c": "id", "d": "label", "e": "graph"}
    pairs = spark.createDataFrame([("m", 0, "p"), ("m", 1, "h"), ("s", 0, "p"), ("q", 0, "p")], "sha string, position int, parent string")
    asked = spark.createDataFrame([("m", "H", 9, "p"), ("s", None, 1, "x"), ("q", None, 2, None), ("gone", None, 1, None)], "sha string, head_sha string, commits int, before_sha string")
    assert {r.sha: r.status for r in co.verified_pairs(asked, pairs).collect()} == {"m": "merge_head_verified", "s": "wrong_before", "q": "unverified", "gone": "unresolved"}
    names = spark.createDataFrame([([1.0],)], "features array<double>").withColumn("feature_names", F.array(F.lit("a")))
    assert co.load_packed(names, ["a"]).first().features == [1.0]
    with pytest.raises(Exception, match="packed for other features"):
        co.load_packed(names, ["b"]).collect()


def test_cards(spark):
    from veinlode.operators import cards as cd

    parts = spark.createDataFrame([("a", 0, "f", 0, "x"), ("a", 0, "f", 1, "y"), ("a", 1, "g", 2, "z"), ("a", 2, "moved", None, None), ("b", 0, "f", 0, "x")], "k string, place int, header string, hunk int, text string")
    assert {r.k: r.diff for r in cd.rendered(parts, "k", F.lit(0)).collect()} == {"a": "f\ny\ng\nz\nmoved\n"}
    assert {r.k: r.diff for r in cd.rendered(parts, "k", F.lit(2)).collect()} == {"a": "f\nx\ny\nmoved\n", "b": "f\nx\n"}
    assert {r.k: r.diff for r in cd.rendered(parts, "k", F.lit(None).cast("int")).collect()} == {"a": "f\nx\ny\ng\nz\nmoved\n", "b": "f\nx\n"}
    empty = "CAST(array() AS array<struct<question: string, answer: string>>)"
    card = F.array(F.struct(F.lit("c").alias("id"), F.lit("T").alias("title"), F.lit("x").alias("text")))
    one = spark.range(1)
    assert one.select(cd.user_message(F.lit("q"), card, F.expr(empty)).alias("m")).first().m == "CARDS:\n\n[c] T\nx\n\nQUESTION: q"
    turns = F.expr("transform(array('1', '2', '3'), x -> struct(x AS question, x AS answer))")
    assert one.select(cd.user_message(F.lit("q"), card, turns).alias("m")).first().m == f"CARDS:\n\n[c] T\nx\n\n{cd.HISTORY}\n\nQ: 2\nA: 2\n\nQ: 3\nA: 3\n\nQUESTION: q"
    twice = spark.createDataFrame([("c", "t")], "id string, title string")
    assert cd.deck(twice).count() == 1
    with pytest.raises(Exception, match="two cards are named c"):
        cd.deck(twice, twice).collect()
    calls = spark.createDataFrame([("s", "main", ["main.f", "mainly.g", "os.path"])], "by string, caller string, callees array<string>")
    modules = spark.createDataFrame([("s", "main"), ("other", "os")], "by string, module string")
    assert {r.callee: r.inner for r in cd.gold_edges(calls, modules, "by").collect()} == {"main.f": True, "mainly.g": False, "os.path": False}
    layout = spark.createDataFrame([("r", "src/p/__init__.py"), ("r", "q/__init__.py"), ("t", "docs/__init__.py"), ("t", "q/__init__.py")], "repo string, path string")
    assert {r.repo: (r.root, r.packages) for r in cd.source_layout(layout).collect()} == {"r": ("src", ["p"]), "t": (".", ["q"])}
    assert [r.e for r in spark.createDataFrame([(None,), ("nothing here",)], "s string").select(cd.evidence_text(F.col("s")).alias("e")).collect()] == ["", ""]


def test_predicted_triples(spark):
    from veinlode.operators import cards as cd

    nodes = spark.createDataFrame(
        [("m", "module", "p\\a.py", "p.a"), ("f", "function", "p\\a.py", "p.a.f"), ("C", "class", "p\\a.py", "p.a.C"), ("x", "external", None, "os.walk"), ("y", "external", None, "p.gone"), ("E", "external", None, "Exception")],
        "id string, type string, path string, qualified_name string",
    )
    edges = spark.createDataFrame([("f", "x", "CALLS"), ("f", "y", "CALLS"), ("f", "C", "CALLS"), ("C", "E", "INHERITS"), ("m", "f", "CONTAINS")], "source string, target string, type string")
    got = {tuple(r) for r in cd.predicted_triples(edges, nodes, ["Exception"]).collect()}
    assert got == {("p/a.py", "CALLS", "p.a.f", "p.gone"), ("p/a.py", "CALLS", "p.a.f", "p.a.C"), ("p/a.py", "INHERITS", "p.a.C", "builtins.Exception")}


@pytest.fixture
def uncoalesced(spark):
    """Small tables keep all their ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_of_a_hot_group(spark, uncoalesced):
    from veinlode.operators import places as pl

    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(400)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = {r.id: (r._p, r._n) for r in pl.numbered(df, ["g"], ["v", "id"]).collect()}
    down = {r.id: r._p for r in pl.numbered(df, ["g"], [F.desc("v"), "id"]).collect()}
    for group in ("hot", "a", None):
        of = [(v, i) for g, v, i in rows if g == group]
        up = sorted(of, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert [got[i] for _, i in up] == [(p, len(of)) for p in range(len(of))]
        assert [down[i] for _, i in sorted(of, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))] == list(range(len(of)))
    assert pl.ranged(df, ["g"], ["id"]).where("g = 'hot'").select("_range").distinct().count() > 1
    assert pl.numbered(df.limit(0), ["g"], ["v"]).count() == 0
    alike = spark.range(999).select(F.lit("x").alias("g"), F.lit(1).alias("v"))
    assert sorted(r._p for r in pl.numbered(alike, ["g"], ["v"]).collect()) == list(range(999))


def test_as_of_over_a_hot_key(spark, uncoalesced):
    rng = random.Random(6)
    right = [(rng.choice(["hot", "hot", "b"]), rng.randrange(500), i) for i in range(400)]
    left = [(rng.choice(["hot", "hot", "b", "none"]), rng.randrange(-9, 520), i) for i in range(900)]
    l, r = spark.createDataFrame(left, "k string, at int, id int"), spark.createDataFrame(right, "k string, at int, v int")
    got = {x.id: x.v for x in t.as_of(l, r, "k", "at", ["v"]).collect()}
    for k, at, i in left:
        seen = [(a, v) for g, a, v in right if g == k and a <= at]
        assert got[i] == (max(seen)[1] if seen else None)


def test_trailing_count_over_a_hot_key(spark, uncoalesced):
    from datetime import datetime, timedelta

    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "b", None]), None if i % 50 == 0 else datetime(2024, 1, 1) + timedelta(hours=12 * rng.randrange(200)), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, at timestamp, id int")
    got = {r.id: r.n for r in t.trailing_count(df, "k", "at", 9, "n").collect()}
    for k, at, i in rows:
        assert got[i] == (None if at is None else sum(1 for g, x, _ in rows if g == k and x is not None and at - timedelta(days=9) <= x <= at))


def test_resumed_and_window_coverage(spark):
    from veinlode.operators import collection as co

    pages = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 3, 2), ("b", 1, 1), ("c", 1, 5)], "repo string, page int, n int")
    state = spark.createDataFrame([("a", 1, False), ("b", None, False), ("c", None, True), ("d", None, False)], "repo string, cursor int, completed boolean")
    assert {r.repo: tuple(r)[1:] for r in co.resumed(pages, state, 2).collect()} == {"a": (2, 2, False), "b": (1, None, True), "c": (0, None, True), "d": (0, None, True)}
    nodes = spark.createDataFrame([("a", 1, 1, 9), ("a", 2, 6, 7), ("a", 3, 11, 12), ("a", 4, 2, 4), ("b", 1, 1, 5), ("b", 2, 2, 50)], "repo string, page int, created int, merged int")
    spans = spark.createDataFrame([("a", 5, 10), ("b", 5, 10)], "repo string, start int, end int")
    got = {r.repo: tuple(r)[1:] for r in co.window_coverage(nodes, spans, 9).collect()}
    assert got == {"a": (3, 3, 2, True, "created_after_window_end"), "b": (2, 2, 1, True, "connection_exhausted")}
    assert [tuple(r)[1:] for r in co.window_coverage(nodes, spans, 1).collect()] == [(1, 1, 1, False, None)] * 2


def test_written_graph(spark, tmp_path):
    from veinlode.operators import relations as rl

    edge = "src string, dst string, relation string"
    before, after = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS")], edge), spark.createDataFrame([("a", "b", "CALLS"), ("a", "c", "IMPORTS")], edge)
    done = rl.write_graph(before, after, ["src", "dst", "relation"], spark.createDataFrame([("c",), ("c",), (None,)], "node string"), str(tmp_path))
    assert done["metrics"].first().asDict() == {"edges": 2, "touched": 1, "added": 1, "removed": 1}
    assert {(r.dst, r.touched) for r in done["graph"].collect()} == {("b", False), ("c", True)}
    again = rl.write_graph(before, before, ["src", "dst", "relation"], spark.createDataFrame([], "node string"), str(tmp_path))  # replaced
    assert again["metrics"].first().asDict() == {"edges": 2, "touched": 0, "added": 0, "removed": 0}


def test_greedy_split_by_hand(spark, uncoalesced):
    import hashlib

    from veinlode.operators import splits as sp

    rng = random.Random(8)
    rows = [(f"r{i}", rng.choice([1, 3, 50])) for i in range(300)]
    total, before, rest, want = sum(n for _, n in rows), 0, 0, {}
    for g, n in sorted(rows, key=lambda x: hashlib.sha256(f"s:{x[0]}".encode()).hexdigest()):
        if before < total * 0.2:
            want[g] = "test"
        else:
            want[g] = "validation" if rest < total * 0.3 else "train"
            rest += n
        before += n
    assert {r.g: r.split for r in sp.greedy_split(spark.createDataFrame(rows, "g string, n int"), "g", "n", "s", 0.2, 0.3).collect()} == want
    assert sp.greedy_split(spark.createDataFrame([], "g string, n int"), "g", "n", "s", 0.2, 0.3).count() == 0


def test_facts_are_handed_on_every_few_hundred_files(spark):
    """A batch of ten thousand files made one batch of all their facts, in Python and again in the JVM."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    files = [{"snapshot_id": "s", "path": f"m{k}.py", "module": f"m{k}", "source": f"X{k} = 1\ndef f():\n    return X{k}\n" if k % 7 else None} for k in range(1300)]
    schema = to_arrow_schema(StructType.fromDDL(ps.FACTS))
    out = list(ps.fact_batches(iter([pa.RecordBatch.from_pylist(files)]), schema))
    assert len(out) == 3 and max(b.num_rows for b in out) <= 4 * 500
    rows = [r for b in out for r in b.to_pylist()]
    assert {r["path"] for r in rows if r["kind"] == "symbol" and r["type"] == "module"} == {f["path"] for f in files}
    assert {r["target"] for r in rows if r["kind"] == "global"} == {f"m{k}.X{k}" for k in range(1300) if k % 7}


def test_the_walk_of_a_definition_keeps_branches_operators_and_imports():
    code = "def f(a):\n    import os\n    if a and not a or a > 1:\n        match a:\n            case 1:\n                from p import q\n    return [q(x) for x in a if x]\n"
    rows = ps.Reader("s", "m.py", "m").read(code)
    assert [r["complexity"] for r in rows if r.get("type") == "function"] == [5]
    assert {r["target"] for r in rows if r["kind"] == "import"} == {"os", "p.q"}
    assert [(r["name"], r["target"], r["via_import"]) for r in rows if r["kind"] == "call"] == [("q", "p.q", True)]


def test_numbers_are_written_as_printf_and_cents_as_decimals(spark):
    x = [-0.04, -0.004, 0.0, -0.0, 0.125, 0.375, 2.675, 1.005, 0.015, 0.145, 0.995, 0.996, -9.999, 1234567.895, 2.0**53 + 2, 4503599627370495.5, 1e17, None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = df.select("x", *[c.fixed(F.col("x"), p, s).alias(f"f{p}{s}") for p in (0, 2, 3) for s in (False, True)]).collect()
    for r in got:
        for p in (0, 2, 3):
            assert r[f"f{p}False"] == (None if r.x is None else f"{r.x:.{p}f}")
            assert r[f"f{p}True"] == (None if r.x is None else f"{r.x:+.{p}f}")
    odd = spark.createDataFrame([(1e300,), (float("inf"),), (float("nan"),)], "x double")
    assert [r.f.split(".")[0] for r in odd.select(c.fixed(F.col("x"), 2).alias("f")).collect()] == ["1" + "0" * 300, "Infinity", "NaN"]
    cents = [(-0.04, "0.0"), (-0.05, "-0.1"), (0.04, "+0.0"), (-0.0, "+0.0"), (0.25, "+0.3"), (-999.85, "-999.9"), (9999.95, "+10000.0"), (None, None)]
    df = spark.createDataFrame(cents, "x double, want string")
    assert [(r.x, r.s) for r in df.select("x", c.signed_cents(F.col("x"), 1).alias("s")).collect()] == cents


def test_a_paired_comparison_draws_each_sample_once(spark):
    """A filter on the drawn weight had every hash computed again, once for each step of the weight."""
    import hashlib
    from math import exp, factorial

    df = spark.createDataFrame([(k, k % 2, 0.25 * (k % 5), 0.5 * (k % 3)) for k in range(40)], "id long, label int, a double, b double")
    out = ev.paired_comparison(df.withColumnRenamed("a", "score"), df.withColumnRenamed("b", "score"), "id", 30)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and not any("Filter" in line and "md5" in line for line in plan.split("\n"))
    steps = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(7)]
    u = lambda r, k: int(hashlib.md5(f"pair:{r}:{k}".encode()).hexdigest()[:12], 16) / 16**12
    drawn = ev.resampled(df, 30).select("resample", "id", ev.poisson_weight("id", "pair").alias("w")).collect()
    assert {(r.resample, r.id): r.w for r in drawn} == {(r, k): sum(u(r, k) >= t for t in steps) for r in range(30) for k in range(40)}
    assert out.first().resamples == 30


def test_files_and_facts_are_never_broadcast(spark, monkeypatch):
    """The planner takes a million generated files for a few MB, under its limit, and the driver had to hold all of them."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    real = store.cut
    monkeypatch.setattr(rs, "cut", lambda df: (plan(df), real(df))[1])
    name = F.concat(F.lit("src/p/m"), F.col("id").cast("string"), F.lit(".py"))
    code = F.concat(F.lit("from p import f\ndef g"), F.col("id").cast("string"), F.lit("():\n    return f()\n"))
    files = spark.range(3).select(F.lit("s").alias("snapshot_id"), name.alias("path"), code.alias("source"))
    files = files.union(spark.createDataFrame([("s", "src/p/__init__.py", "from p.a import f\n"), ("s", "src/p/a.py", "def f():\n    pass\n")], files.schema))
    named = rs.with_modules(files)
    facts = store.cut(ps.extract(named))
    found = store.cut(rs.nodes(facts))
    links = rs.edges(facts, found)
    plan(named)
    plan(links)
    # two rounds of re-exports, the names' nodes, the resolved uses, with_modules, edges
    assert len(plans) == 6 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert {(r.source, r.target) for r in links.where("type = 'CALLS'").collect()} == {(f"src/p/m{k}.py:p.m{k}.g{k}", "src/p/a.py:p.a.f") for k in range(3)}


def test_node_features_are_joined_without_broadcasts(spark):
    found = spark.sql("SELECT 's' AS snapshot_id, id FROM VALUES ('a'), ('b'), ('c') AS t(id)")
    links = spark.sql("SELECT 's' AS snapshot_id, * FROM VALUES ('a', 'b', 'CALLS'), ('a', 'b', 'CONTAINS'), ('b', 'a', 'IMPORTS') AS t(source, target, type)")
    out = rs.node_features(store.cut(found), store.cut(links))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.id: (r.out_degree, r.in_degree, r.calls) for r in out.collect()} == {"a": (2, 1, 1), "b": (1, 2, 0), "c": (0, 0, 0)}


def test_predicted_triples_are_joined_without_broadcasts(spark):
    from veinlode.operators import cards as cd

    nodes = spark.sql("SELECT * FROM VALUES ('m', 'module', 'p/a.py', 'p.a'), ('f', 'function', 'p/a.py', 'p.a.f'), ('x', 'external', NULL, 'os.walk'), ('y', 'external', NULL, 'p.gone'), ('z', NULL, NULL, 'p.odd'), ('n', 'external', NULL, NULL) AS t(id, type, path, qualified_name)")
    edges = spark.sql("SELECT 'f' AS source, *, 'CALLS' AS type FROM VALUES ('f'), ('x'), ('y'), ('z'), ('n') AS t(target)")
    out = cd.predicted_triples(store.cut(edges), store.cut(nodes), [])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r.name for r in out.collect()) == ["p.a.f", "p.gone", "p.odd"]
