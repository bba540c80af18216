"""The operators over documents against brute force, on the smallest tables and on hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veinlode.llm import decontaminate, mixing, neardup, pii, quality, rules, sharding, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, id long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SEEDED = random.Random(4)
LONG = " ".join(SEEDED.choice(["uno", "dos", "tres", "été", "fünf"]) + str(i % 97) for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "one", "one two", "One TWO three", "one two three", LONG, LONG + " end", "mail a.b@c.de, +1 (555) 123-4567 and 10.0.0.1",
    "pay 4111 1111 1111 1111 <|endoftext|> now", "x" * 5000, "a\na\na\nb b b b b b\n#$%", "Ünïcode ʼn ß ﬁ \U0001f600 \x1c\x85 z",
]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with results."""
    rows = [(i, t, None, None if i % 3 == 0 else f"s{i % 2}", None, 1.0, 7, 5) for i, t in enumerate(TEXTS)]
    rows += [(None, "one two three", None, None, None, None, None, None), rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


LABELS = "doc_id long, quality int"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(
        [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    ):
        for m in re.finditer(pattern, text):
            d = [int(x) for x in re.findall("[0-9]", m.group())]
            twice = [x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])]
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True, 14 <= len(d) <= 19 and sum(twice) % 10 == 0, 10 <= len(d) <= 15]
            if ok[kind]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_pii_base_is_the_plain_rules():
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("a1@.+- (0255)_é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(s) == plain_spans(s), s
    assert pii.base_spans("@" * 200_000 + "9" * 200_000) == []


def test_pii_digest(spark, hard, empty, docs):
    assert pii.digest(empty).count() == 0
    assert pii.digest(hard).count() == hard.count()
    got = by_id(pii.digest(docs))
    for row in docs.collect():
        base = plain_spans(row.text or "")
        named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[row.doc_id].base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert got[row.doc_id].n_email == sum(k == 0 for _, k, _ in base)
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(got[row.doc_id].spans.split(","))


def test_pii_added_to_documents_is_right(spark):
    """On the documents the method adds the secrets, and card numbers only with a right check digit."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    wanted = found = 0
    for row, spans in zip(rows, pii.judge(pii.train(), [r.text for r in rows])):
        extra = [(k, row.text[s:e]) for s, k, e, p in spans if p < 1]
        assert all(pii.luhn(pii.only_digits(t)) for k, t in extra if k == 2)
        named = set(re.findall(r'token = "([0-9a-f]+)"', row.text))
        wanted, found = wanted + len(named), found + len(named & {t for k, t in extra if k == 4})
        assert {t for k, t in extra if k == 4} <= named
    assert wanted and found == wanted


def test_pii_model_and_redaction(spark):
    model = pii.train()
    assert model["recall"] > 0.95 and model["precision"] > 0.95
    df = spark.createDataFrame([("call (555) 123-4567 or john (at) example (dot) com", 1), (None, 2), ("on 2024-05-03", 3)], "text string, k int")
    got = {r.k: r.text for r in pii.redact(df, model=model).collect()}
    assert got == {1: "call <PHONE> or <EMAIL>", 2: None, 3: "on 2024-05-03"}


def test_pii_finds_neighbouring_numbers():
    model = pii.train()
    cases = {
        "415-555-1234 / 415-555-9999": [("phone", "415-555-1234"), ("phone", "415-555-9999")],
        "415-555-1234 415-555-9999": [("phone", "415-555-1234"), ("phone", "415-555-9999")],
        "(415) 555-1234 (415) 555-9999": [("phone", "(415) 555-1234"), ("phone", "(415) 555-9999")],
        "4111-1111-1111-1111 12/25": [("card", "4111-1111-1111-1111")],
        "2024-05-01 415-555-1234": [("phone", "415-555-1234")],
        "on 2024-05-03": [],
    }
    found = pii.judge(model, list(cases))
    assert [[(pii.KINDS[k], t[s:e]) for s, k, e, _ in f] for t, f in zip(cases, found)] == list(cases.values())
    assert len(pii.candidates("1 " * 20_000)) < 20_000 * 21


def test_quality_held_out(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.digest(big, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_is_a_plain_neighbour_vote(spark, docs):
    """Every score from all cosines, one pair at a time, with the operator's vectors."""
    import numpy as np

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out("doc_id"))
    model = quality.learn(docs, labels, doc_id="doc_id", text="text", quality="quality", max_labelled=4096, axes=48)
    near, power = 24, 8.0
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = by_id(quality.digest(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert len(model["labels"]) == labels.where("quality IS NOT NULL").select("doc_id").distinct().count()
    for doc_id, text in texts.items():
        at, n = quality.terms(text.encode())
        x = np.zeros(quality.N_TERMS, dtype=np.float64)
        x[at] = np.log1p(n / n.sum() * 1000) * model["rarity"][at]
        v = x / np.linalg.norm(x) @ model["basis"].astype(np.float64)
        v /= np.linalg.norm(v)
        cosines = sorted(((float(np.dot(v, w)), float(y)) for w, y in zip(model["vectors"], model["labels"])), reverse=True)
        votes = [(max(c, 0.0) ** power, y) for c, y in cosines[:near]]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes)
        assert got[doc_id].score == pytest.approx(want, abs=2e-2)


def test_quality_hard_cases(spark, hard, empty, docs):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (12, 0), (None, 1), (9, None), (0, 1)], LABELS)
    got = quality.digest(hard, labels)
    assert got.count() == hard.count()
    assert {r.score for r in got.where("doc_id IN (0, 1, 2)").collect()} == {0.0}
    assert quality.digest(empty, labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.digest(docs, none).collect()} == {0.5}
    kept = quality.keep_good(hard, labels, least=0.0)
    assert kept.columns == hard.columns and kept.count() == hard.count()


def leak_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_leaks(text, items):
    w, hit, found = leak_words(text), set(), set()  # a null id hits, counts as one item, and has no name
    for item, t in items:
        v = leak_words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            part = v[i : i + 10]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    found.add(item)
    named = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(named).encode()).hexdigest()


def test_decontamination(spark, hard, empty, docs):
    items = [(1, "One two"), (2, "TWO, three!"), (3, None), (4, " .. "), (10, LONG[5:400]), (10, LONG[5:400]), (None, "one"), (5, "été3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for some, items_ in ((hard, items), (docs.limit(60), None)):
        b = bench if items_ else spark.read.parquet(f"{SF}/benchmark.parquet")
        items_ = items_ or [(r.item_id, r.text) for r in b.collect()]
        texts = {r.doc_id: r.text for r in some.select("doc_id", "text").collect()}
        for row in decontaminate.digest(some, b).collect():
            if row.doc_id is not None:
                assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == plain_leaks(texts[row.doc_id], items_)
    assert decontaminate.digest(empty, bench).count() == 0
    assert decontaminate.digest(hard, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.drop_leaks(hard, bench)
    assert kept.columns == hard.columns
    whole = decontaminate.find_leaks(hard, bench, keep=["doc_id"]).collect()
    cut = decontaminate.find_leaks(hard, bench, keep=["doc_id"], max_pattern_bytes=8).collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    spans = decontaminate.find_leaks(hard.where("doc_id = 5"), bench, keep=["text"]).first()
    assert [spans.text[s.start : s.end] for s in spans.spans] == ["One TWO three"]


def test_sharding(spark, hard, empty, docs):
    assert sharding.digest(empty).count() == 0
    for some in (hard, docs):
        rows = sharding.digest(some).collect()
        assert len(rows) == some.count()
        assert all(r.grown_shard in (r["shard"], 8) for r in rows)
        for s, n in Counter(r["shard"] for r in rows).items():
            assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(n))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 for r in rows)
    kept = sharding.shard(hard, {0: 1.0, 1: 3.0})
    assert kept.columns == [*hard.columns, "shard_", "slot"]
    many = spark.range(20_000).withColumnRenamed("id", "doc_id")
    share = sharding.shard(many, {0: 1.0, 1: 3.0}).where("shard = 1").count() / 20_000
    assert abs(share - 0.75) < 0.02


MASK = (1 << 64) - 1


def test_shards_are_the_least_cost(spark, hard, docs):
    """Each record's shard from its own hashes, shard by shard; a null key has the hash of the shard alone."""
    import math

    import xxhash

    def cost(key, shard, weight=1.0):
        h = 42
        for v in (key, shard):
            h = h if v is None else xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed=h)
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight, shard

    for some in (hard, docs):
        for r in sharding.digest(some).collect():
            assert r["shard"] == min(cost(r.doc_id, s) for s in range(8))[1]
            assert r.grown_shard == min(cost(r.doc_id, s) for s in range(9))[1]
    for r in sharding.shard(docs, {0: 1.0, 3: 2.5, 4: 0.5}).collect():
        assert r["shard"] == min(cost(r.doc_id, s, w) for s, w in ((0, 1.0), (3, 2.5), (4, 0.5)))[1]


def test_rules(spark, hard, empty, docs):
    assert rules.digest(empty).count() == 0
    for some in (hard, docs):
        texts = {r.doc_id: r.text for r in some.select("doc_id", "text").collect()}
        for r in rules.digest(some).collect():
            s = texts[r.doc_id] or ""
            w = SPACE.findall(s)
            lines = [x for x in s.split("\n") if SPACE.search(x)]
            c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(again))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
            assert not (r.base_failed and r.kept)


def test_rule_order_changes_no_verdict(spark, hard, empty, docs):
    text = F.col("text")
    wide = rules.measured(docs, text)
    found = rules.standard_rules(text, {n: F.col(n + "_" * (n == "n_chars")) for n in (*rules.MEASURES, "n_lines")})
    one = rules.cascade(wide, found).select("doc_id", F.col("rejected_by").isNull().alias("k")).collect()
    none = F.lit(True)
    for rule in found.values():
        none = none & ~F.coalesce(rule, F.lit(False))
    assert sorted(map(tuple, one)) == sorted(map(tuple, wide.select("doc_id", none.alias("k")).collect()))
    order = rules.ordered(rules.measured(rules.sample_of(docs), text), found)
    assert {r["rule"] for r in order} == set(found)
    assert [r["rejects"] / r["cost"] for r in order] == sorted((r["rejects"] / r["cost"] for r in order), reverse=True)
    kept = {r.doc_id for r in rules.digest(docs).where("kept").collect()}
    assert {r.doc_id for r in rules.keep_fine(docs).collect()} == kept
    assert rules.keep_fine(hard).columns == hard.columns and rules.keep_fine(empty).count() == 0


def plain_groups(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, set()).update({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else ())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_neardup_on_chains_and_near_misses(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for step in range(40):  # a chain: each text differs from the one before it, far ones are no copies
        base = [f"v{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base]
        texts.append(" ".join(base))
    for step in range(40):  # near misses and copies of the last
        texts.append(" ".join(f"u{rng.randrange(10**6)}" if rng.random() < 0.02 + step / 500 else w for w in base))
    rows = list(enumerate(texts)) + [(900, texts[3].upper()), (901, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = plain_groups(rows, 2)
    got = by_id(neardup.digest(df))
    assert {i: got[i].component_id for i in got} == want
    assert all(got[i].n_shingles == len(sets[i]) for i in got)


def test_neardup_hard_cases(spark, hard, empty, docs):
    assert neardup.digest(empty).count() == 0
    got = neardup.digest(hard).collect()
    assert len(got) == hard.count()
    one = {r.doc_id: r for r in got}
    assert one[None].component_id is None and one[None].kept
    assert [one[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert all(one[i].component_id == i for i in range(5))
    assert one[6].component_id == 5 and one[8].component_id == 7
    texts = [(1, "a b c d"), (1, "quite other words here"), (2, "A b  c d"), (3, "quite other words here"), (3, None), (3, None), (1, "a b c d")]
    kept = neardup.drop_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), size=2).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "a b c d"), (1, "quite other words here"), (3, ""), (3, "")]
    named = spark.createDataFrame([("x", "a b c"), ("b", "a b c"), ("c", "d")], "doc_id string, text string")
    assert sorted((r.id, r.component) for r in neardup.find_groups(named, size=2).collect()) == [("b", "b"), ("c", "c"), ("x", "b")]
    kept = neardup.drop_duplicates(hard, size=2)
    assert kept.columns == hard.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", *[str(i) for i in range(len(TEXTS)) if i not in (6, 8)]])


def test_sketch_agreement_follows_similarity():
    s = neardup.Shingles(1)
    a = s.of(" ".join(f"x{i}" for i in range(400)).encode())
    b = s.of(" ".join(f"x{i}" for i in range(100, 500)).encode())
    assert abs((neardup.sketch(a) == neardup.sketch(b)).mean() - 300 / 500) < 0.15
    assert (neardup.sketch(s.of(b"alone")) == neardup.sketch(s.of(b"alone"))).all()


def test_mixing(spark, hard, empty, docs):
    assert mixing.digest(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0
    for some in (hard, docs):
        rows = mixing.digest(some).collect()
        assert len(rows) == some.count()
        assert all(r.taken <= 3 * r["size"] for r in rows)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.digest(some).collect()))
    sized = {r.doc_id: r for r in rows}
    by_source = {}
    for r in docs.collect():
        assert sized[r.doc_id]["size"] == len(SPACE.findall(r.text))
        by_source.setdefault(r.source, []).append(sized[r.doc_id])
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 130


def test_mixing_takes_the_blocks_of_its_slots(spark, docs):
    """``taken`` again, from the layout and the draws, block by block and word by word."""
    import numpy as np

    made = mixing.mix(docs)
    block, shards, seed = 64, 64, 11
    n_blocks = np.array([-(-s.size // block) for s in made.sources])
    owed = np.array([round(s.target * int(n) / s.size) if s.size else 0 for s, n in zip(made.sources, n_blocks)])
    counts = mixing.draws(owed, shards, seed)
    assert (counts.sum(0) == owed).all()
    read = Counter()
    for i, n in enumerate(n_blocks):
        for k in range(int(owed[i])):
            key = np.array([((i * 1_000_003 + k // int(n)) * 2_654_435_761 + seed) % 2**64], dtype=np.uint64)
            read[i, int(mixing.permuted(np.array([k % int(n)]), np.array([n]), key)[0])] += 1
    assert max(read.values()) <= 3
    want, ends = {}, {}
    for r in made.rows.collect():
        assert ends.setdefault((r.source_no, r.start), r.doc_id) == r.doc_id or r["size"] == 0
        want[r.doc_id] = sum(read[r.source_no, w // block] for w in range(r.start, r.start + r["size"]))
    for i, s in enumerate(made.sources):  # a source's documents lie end to end
        own = sorted((r.start, r["size"]) for r in made.rows.collect() if r.source_no == i and r["size"])
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) == s.size
    assert {r.doc_id: r.taken for r in mixing.digest(docs).collect()} == want


def test_targets_share_the_excess():
    sources = mixing.targets([("b", 10), (None, 100), ("a", 100), ("c", 0)], lambda i, n: [1, 1000, 1, 1][i], 3)
    assert [s.name for s in sources] == ["a", "b", "c", None]
    assert [s.target for s in sources] == [90.0, 30.0, 0.0, 90.0]


def test_permutation_is_one_to_one():
    import numpy as np

    for n in (1, 2, 5, 64, 1000):
        k = np.arange(n)
        got = mixing.permuted(k, np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(got.tolist()) == k.tolist()


def test_mixed_texts_hold_the_words_taken(spark, docs):
    taken = {r.doc_id: r.taken for r in mixing.digest(docs).collect()}
    made = mixing.mixed_texts(docs)
    assert made.columns == docs.columns
    words, texts = Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in made.collect():
        words[r.doc_id] += len(SPACE.findall(r.text))
        assert r.n_chars == len(r.text)
        assert all(part in texts[r.doc_id] for part in r.text.split("\n")[:1])
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_tokens_are_the_library_s(spark, hard, empty, docs):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    own = Tokenizer.from_str(spec)
    assert tokens.digest(empty, spec).count() == 0
    for some in (hard, docs):
        texts = {r.doc_id: r.text or "" for r in some.select("doc_id", "text").collect()}
        for r in tokens.digest(some, spec).collect():
            assert r.n_tokens == len(own.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024)
    rng = random.Random(1)
    count = tokens.counter(spec, tokens.prove(own))
    some = ["".join(rng.choice("ab Z1\n\t'sé²Ⅷ \x1c\x85 中ñ!́\U0001f600٣ aaaa") for _ in range(rng.randrange(30))) for _ in range(2000)]
    some += ["a" * 3000, "<|endoftext|><|endoftext|>", " " * 99 + "x"]
    assert count(some) == [len(own.encode(s, add_special_tokens=False).ids) for s in some]


def test_tokens_of_another_tokenizer(spark, docs):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    own = Tokenizer.from_str(spec)
    got = by_id(tokens.count_tokens(docs.limit(20), spec, keep=["doc_id"]))
    for r in docs.limit(20).collect():
        assert got[r.doc_id].n_tokens == len(own.encode(r.text, add_special_tokens=False).ids)


def test_pandas_is_not_needed_by_native_operators():
    assert not any(hasattr(m, "pd") for m in (rules, sharding)) and pd is not None
