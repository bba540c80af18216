"""Every query that has a DuckDB twin returns the twin's rows on the smallest tables."""

import math

import duckdb
import pytest

from veinlode.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: A query of each family; the whole list runs through the driver's gate.
CHOSEN = [
    "gr04_module_coupling", "gr08_clustering", "gr09_degree_entropy", "gr12_graph_change", "jn06_as_of_commit", "jn07_interval_pairs",
    "jn09_interval_overlap", "lb03_outcome_labels", "wn02_chronological_cutoffs", "wn03_evenly", "wn04_greedy_split", "ev02_average_precision",
    "ev03_roc_auc", "ev10_set_scores", "ev16_friedman", "ev17_krippendorff", "xr12_bm25", "fe06_tfidf", "fl10_production_files", "io18_merge_sparse",
]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([norm(r[c]) for c in columns]) for r in got.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall())


def test_every_query_has_a_name_of_its_family():
    assert len(QUERIES) > 90
    assert set(ORACLES) <= set(QUERIES)
