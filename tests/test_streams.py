from pyspark.sql import functions as F

from veinlode.plans import registry
from veinlode.streaming import streams as st

SF = "/root/testdata/sf0.001"


def test_sessions_and_dedupe(spark):
    q = registry.queries()
    assert q["st02_deduplicated"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_split_sinks_replace_on_replay(spark, tmp_path):
    like = spark.read.parquet(f"{SF}/events.parquet")
    stream = st.read(spark, f"{SF}/events.parquet", like)
    a, b, log = (str(tmp_path / x) for x in ("a", "b", "log"))
    for _ in range(2):
        st.split_sinks(stream, F.col("value") > 50, a, b, log)
    assert spark.read.parquet(b).count() == like.count()
    assert spark.read.parquet(a).count() == like.where("value > 50").count()


def test_context_is_carried_whole(spark):
    got = {(r.conv_id, r.turn): r.context for r in registry.queries()["st08_whole_context"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own = r.text if r.role == "user" and r.text else want.get((r.conv_id, r.turn - 1))
        want[r.conv_id, r.turn] = own
    assert got == want and max(len(x or "") for x in got.values()) > 20
