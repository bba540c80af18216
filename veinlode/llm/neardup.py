"""Near-duplicates: fast similarity sketches, banding, and verification on full shingle sets.

A text's set holds its distinct word shingles. Texts with equal sets form one class at once, and
only class representatives go on. A sketch has ``COORDS`` coordinates. Round r hashes every
shingle with the r-th hash function to a bin and a value; an empty bin takes the smallest value
of the first round that reaches it. After ``COORDS`` such rounds, round COORDS + b puts every
shingle into bin b, so each coordinate is filled for any set that isn't empty, and agreement of
coordinates concentrates around the Jaccard similarity as with independent hash functions. Large
sets need one round or two.

``BANDS`` bands of ``ROWS`` coordinates propose candidates: a pair of similarity 0.8 misses all
32 bands of 4 with probability 5e-8. Buckets with the same members count once. Pairs within a bucket
are never listed. First each member is verified against two leaders of each of its buckets (a star,
linear in the bucket), and links give components. A bucket that still holds several components goes
on: only members outside its largest component are compared with others, by one byte of each
coordinate, in blocks of ``BLOCK`` members or a few times the root of the bucket's size, so that members
of one component meet no more, and neither rows per member nor a task hold a whole bucket. A member whose
sketch agrees enough with a member of a larger component (``LEAST_AGREE`` coordinates, four standard
deviations under 0.8) becomes a visitor of that component. A component's full sets lie in blocks of
``HOSTS``, its visitors in chunks of ``GUESTS``, and every chunk meets every block, so a near miss costs a
row per block, not per pair. No cap drops a candidate.

Every link is confirmed on the full sets of 64-bit shingle hashes: 100 * common >= 80 * union.

Defined cases: ids may be of any type that sorts; null text, and text without words, is an empty set,
linked with nothing and kept; with fewer words than a shingle the whole sequence is one shingle;
repeated rows join one class, and one of them is kept; rows of one id with unrelated texts are documents
of their own; rows with a null id are linked with nothing, have a null component and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, join_split, map_batches, materialise, need
from .components import components

COORDS, BANDS, ROWS = 128, 32, 4
LEAST_AGREE = int(COORDS * 0.66)

U = np.uint64
BASE, GOLD = U(0x9E3779B97F4A7C55), U(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingles:
    """Distinct shingle hashes of whole texts; powers of the word hash's base are kept between texts."""

    def __init__(self, size: int = 2) -> None:
        self.size = size
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        inverse = U(pow(int(BASE), -1, 1 << 64))
        self.power, self.back = (np.concatenate(([U(1)], np.full(n, b, dtype=U))).cumprod(dtype=U) for b in (BASE, inverse))

    def of(self, raw: bytes | None) -> np.ndarray:
        """Sorted distinct hashes."""
        if not raw or not (raw := raw.lower().strip()):
            return np.zeros(0, dtype=U)
        if len(raw) >= len(self.power):
            self.grow(2 * len(raw))
        chars = np.frombuffer(raw, dtype=np.uint8)
        blank = SPACES[chars]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        total = np.concatenate(([U(0)], ((chars.astype(U) + U(1)) * self.power[: len(chars)]).cumsum(dtype=U)))
        words = mix((total[ends] - total[starts]) * self.back[starts] + (ends - starts).astype(U) * GOLD)
        n, k = len(words), min(self.size, len(words))
        out = np.full(n - k + 1, k, dtype=U) * GOLD
        for i in range(k):
            out = mix(out + words[i : n - k + 1 + i])
        return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``COORDS`` coordinates of 32 bits, all filled; the set must not be empty."""
    n, at = len(shingles), 0
    bins = np.full(COORDS, np.iinfo(np.uint64).max, dtype=U)
    step = max(1, int(np.ceil(COORDS * (np.log(COORDS) + 1) / n)))
    while at < COORDS and (at == 0 or (bins == np.iinfo(np.uint64).max).any()):
        rounds = np.arange(at, min(COORDS, at + step), dtype=U)
        h = mix(shingles[None, :] + (rounds[:, None] + U(1)) * GOLD)
        np.minimum.at(bins, (h & U(COORDS - 1)).ravel().astype(np.int64), ((rounds[:, None] << U(32)) | (h >> U(32))).ravel())
        at += len(rounds)
    for b in np.flatnonzero(bins == np.iinfo(np.uint64).max):
        r = np.array([COORDS + int(b)], dtype=U)
        bins[b] = (r[0] << U(32)) | (mix(shingles + (r + U(1)) * GOLD) >> U(32)).min()
    return (mix(bins) >> U(32)).astype(np.uint32)


def text_key(df: DataFrame, text: str) -> F.Column:
    return F.xxhash64(df[f"`{text}`"])


def sketched(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, key, n, set, sketch) of every row; key is a hash of the text, set and sketch are null for empty sets."""

    def make() -> Callable:
        shingles = Shingles(size)

        def work(batch: dict) -> tuple[list, None]:
            n, keys, sketches = [], [], []
            seen: dict[bytes, bytes] = {}
            for raw in batch["text"].to_pylist():
                own = shingles.of(raw)
                key = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                if key is not None and key not in seen:
                    seen[key] = sketch(own).tobytes()
                n.append(len(own))
                keys.append(key)
                sketches.append(seen.get(key))
            return [n, keys, sketches], None

        return work

    rows = docs.select(docs[f"`{doc_id}`"].alias("id"), text_key(docs, text).alias("key"), docs[f"`{text}`"].cast("binary").alias("text"))
    fields = [("n", T.LongType()), ("set", T.BinaryType()), ("sketch", T.BinaryType())]
    return map_batches(rows, {"text": F.col("text")}, ["id", "key"], fields, make)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, size: int) -> DataFrame:
    """(no, shingles as an array of longs) of the classes ``wanted`` (no, id, key), each from the row that it names.

    The classes may be a third of all, so they are not broadcast, whatever their number here: texts are dealt by id.
    """

    def make() -> Callable:
        shingles = Shingles(size)
        return lambda batch: ([[shingles.of(raw).view(np.int64) for raw in batch["text"].to_pylist()]], None)

    rows = docs.select(docs[f"`{doc_id}`"].alias("id"), text_key(docs, text).alias("key"), docs[f"`{text}`"].cast("binary").alias("text"))
    rows = rows.hint("merge").join(wanted.hint("merge"), ["id", "key"])
    made = map_batches(rows, {"text": F.col("text")}, ["no"], [("shingles", T.ArrayType(T.LongType()))], make)
    return made


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v), a written table, whose full sets have 100 * common >= percent * union.

    The leader of a large bucket is in many pairs, on either side, so both joins split such keys.
    """
    one = sets.select(F.col("no").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("no").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    fits = (100 * F.least(F.size("a"), F.size("b")) >= percent * F.greatest(F.size("a"), F.size("b"))) & (
        100 * common >= percent * (F.size("a") + F.size("b") - common)
    )
    first = join_split(pairs, one, "u", F.col("v"))
    return join_split(first, two, "v", F.col("u"), counted=pairs).where(fits).select("u", "v")


def matches(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of a and b, of one byte a coordinate, that agree in ``least`` coordinates or more."""
    step = max(1, (1 << 15) // max(1, len(b)))
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(a), step):
        i, j = np.nonzero((a[at : at + step, None, :] == b[None, :, :]).sum(2, dtype=np.uint8) >= least)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def agreeing(group: pd.DataFrame) -> pd.DataFrame:
    """For some block pairs of buckets: (node, host) where a node's sketch agrees enough with one of a larger component.

    Of components of one size the one with the smaller number counts as larger. Side 0 and 2 are the two blocks; 1
    is a block that meets itself.
    """
    group = group.sort_values(["bucket", "i", "j", "side"], kind="stable")
    sketches = np.frombuffer(b"".join(group.sketch), dtype=np.uint8).reshape(-1, COORDS)
    no, comp, size, side = (group[c].to_numpy() for c in ("no", "component", "size", "side"))
    place = group[["bucket", "i", "j"]].to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1), [True])))
    found = [np.zeros((0, 2), dtype=np.int64)]
    for first, past in zip(edges[:-1], edges[1:]):
        k = first + int(np.searchsorted(side[first:past], 1, side="right")) if side[first] != 1 else past
        low = first if side[first] == 1 else k
        x, y = matches(sketches[first:k], sketches[low:past], LEAST_AGREE)
        x, y = x + first, y + low
        x, y = x[comp[x] != comp[y]], y[comp[x] != comp[y]]
        up = (size[y] > size[x]) | ((size[y] == size[x]) & (comp[y] < comp[x]))
        pairs = np.stack([np.where(up, no[x], no[y]), np.where(up, comp[y], comp[x])], axis=1)
        found.append(np.unique(pairs, axis=0) if len(pairs) else pairs)
    out = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"node": out[:, 0], "host": out[:, 1]})


def visits(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For one block of a component: the first member that each visitor is linked with."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        own, guests = group[~group.guest], group[group.guest]
        if not len(own) or not len(guests):
            return pd.DataFrame({"u": np.zeros(0, dtype=np.int64), "v": np.zeros(0, dtype=np.int64)})
        lengths = np.array([len(x) for x in own.shingles])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        all_ = np.concatenate(list(own.shingles))
        names, us, vs = own.no.to_numpy(), [], []
        for no, mine in zip(guests.no, guests.shingles):
            mine = np.sort(mine)
            at = np.minimum(np.searchsorted(mine, all_), len(mine) - 1)
            common = np.add.reduceat((mine[at] == all_).astype(np.int64), starts)
            good = np.flatnonzero(100 * common >= percent * (lengths + len(mine) - common))
            if len(good):
                us.append(no)
                vs.append(names[good[0]])
        return pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})

    return links


#: Whole texts that a Python worker is handed at once.
TEXTS = 500
#: Full sets of one component that a task compares with visitors, and visitors that it compares them with.
HOSTS, GUESTS = 200, 1000
#: Least members of a block of an open bucket, and rows of such blocks that a task compares.
BLOCK, PER_TASK = 250, 4000


def grouped(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(id, key, n, head) of every row: ``head`` is the row of its group that stays, as struct<id, set, key>; null for
    rows that are linked with nothing."""
    need(docs, doc_id, text)
    rows = materialise(sketched(docs, doc_id, text, size), TEXTS)
    named = rows.where(F.col("set").isNotNull() & F.col("id").isNotNull())
    classes = named.groupBy("set").agg(F.min(F.struct("id", "key")).alias("first"), F.min("sketch").alias("sketch"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("no"), "*"))
    repeated = not named.groupBy("id", "key").count().where("count > 1").isEmpty()
    found = linked(docs, doc_id, text, classes, repeated, size, percent)
    own = F.struct("first.id", "set", "first.key").alias("own")
    homes = materialise(classes.select("no", "set", own).join(found.withColumnRenamed("node", "no"), "no", "left"))
    grown = homes.where("component IS NOT NULL").select("component", "set", "own")
    heads = materialise(grown.groupBy("component").agg(F.min("own").alias("head")))
    head_of = join_split(grown, heads, "component", F.col("set")).select("set", "head")
    head_of = head_of.union(homes.where("component IS NULL").select("set", "own"))
    done = rows.select("id", "key", "n", F.when(F.col("id").isNotNull(), F.col("set")).alias("set")).join(head_of, "set", "left")
    return done.select("id", "key", "n", "head")


def linked(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, repeated: bool, size: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with another one; ``repeated``: rows share id and text."""
    width = 4 * ROWS
    keys = [F.xxhash64(F.lit(j), F.substring("sketch", 1 + width * j, width)) for j in range(BANDS)]
    bands = classes.select("no", F.explode(F.array(*keys)).alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("no", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    heads = bands.groupBy("bucket").agg(F.min("no").alias("low"), F.max("no").alias("high"), F.count("*").alias("k"), *marks).where("low < high")
    heads = heads.groupBy("low", "high", "k", "mark0", "mark1").agg(F.min("bucket").alias("bucket"))  # one of those with the same members
    members = materialise(bands.join(heads.select("bucket", "low", "high", "k"), "bucket"))
    wanted = members.select("no").distinct().join(classes.select("no", "first.id", "first.key"), "no")
    sets = shingle_sets(docs, doc_id, text, wanted, size)
    sets = materialise(sets.groupBy("no").agg(F.first("shingles").alias("shingles")) if repeated else sets, TEXTS)

    stars = members.select("no", F.explode(F.array("low", "high")).alias("head")).where("no <> head")
    tried = materialise(stars.select(F.least("no", "head").alias("u"), F.greatest("no", "head").alias("v")).distinct())
    links = materialise(verified(tried, sets, percent))
    found = components(links)
    late = materialise(visitors(members, classes, sets, found, percent))
    return found if late.isEmpty() else components(links.union(late))


def find_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) of every row. ``size``: words of a shingle; ``percent``: least similarity."""
    done = grouped(docs, doc_id, text, size, percent)
    return done.select("id", F.col("n").alias("n_shingles"), F.coalesce("head.id", "id").alias("component"))


def visitors(members: DataFrame, classes: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the components ``found`` so far."""
    label = members.select("bucket", "no", "k").join(found.withColumnRenamed("node", "no"), "no", "left")
    label = materialise(label.select("bucket", "no", "k", F.coalesce("component", "no").alias("component")))
    placed = materialise(label.select("no", "component").distinct())
    sizes = materialise(placed.groupBy("component").agg(F.count("*").alias("size")))
    # Of each open bucket its largest component, and blocks of the others (the rest) and of it.
    per = label.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.first("k").alias("k"))
    most = per.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("g"), F.first("k").alias("k")).where("g.n < k")
    block = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("k") * 8))
    count = lambda n: F.ceil(n / block).cast("int")
    most = most.select("bucket", "k", F.col("g.n").alias("n"), (-F.col("g.c")).alias("largest"), count(F.col("k") - F.col("g.n")).alias("rest"), count(F.col("g.n")).alias("blocks"))
    most = materialise(most)
    listed = most.agg(F.sum((F.col("k") - F.col("n")) * (F.col("rest") + F.col("blocks")) + F.col("n") * F.col("rest"))).first()[0] or 0
    bytes_ = F.concat(*[F.substring("sketch", 1 + 4 * i, 1) for i in range(COORDS)])  # the lowest byte of each coordinate
    inside = label.drop("k").join(most.drop("k", "n"), "bucket").join(sizes, "component").join(classes.select("no", bytes_.alias("sketch")), "no")
    outside, hashed = F.col("component") != F.col("largest"), F.xxhash64("no")
    own = F.when(outside, F.pmod(hashed, F.col("rest"))).otherwise(F.col("rest") + F.pmod(hashed, F.col("blocks"))).cast("int").alias("own")
    # Blocks of the rest meet each other and those of the largest component once, as task (i, j) with i <= j.
    kept = ["bucket", "no", "component", "size", "sketch"]
    other = F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(outside, F.col("blocks")).otherwise(F.lit(0)) - 1)).alias("other")
    spread = inside.select(*kept, own, other)
    side = F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2).alias("side")
    spread = spread.select(*kept, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side)
    spread = spread.withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, listed // PER_TASK))))
    near = materialise(spread.groupBy("task").applyInPandas(agreeing, "node long, host long").distinct())

    hosts = near.groupBy(F.col("host").alias("component")).agg(F.count("*").alias("guests")).join(sizes, "component")
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    hosts = materialise(hosts.select("component", parts("size", HOSTS).alias("blocks"), parts("guests", GUESTS).alias("chunks")))
    some = lambda n: F.pmod(F.xxhash64("no"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = join_split(placed, hosts, "component", F.col("no")).select("component", some("blocks").alias("block"), each("chunks").alias("chunk"), "no", F.lit(False).alias("guest"))
    guests = near.select(F.col("node").alias("no"), F.col("host").alias("component"))
    guests = join_split(guests, hosts, "component", F.col("no")).select("component", each("blocks").alias("block"), some("chunks").alias("chunk"), "no", F.lit(True).alias("guest"))
    # Guests are listed per block, so their table is larger than what it is made from: never broadcast it.
    both = homes.union(guests).hint("merge").join(sets.hint("merge"), "no")
    return both.groupBy("component", "block", "chunk").applyInPandas(visits(percent), "u long, v long").distinct()


def drop_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns as they were; of rows with the same id
    and text, one. Rows without a word or an id all stay."""
    groups = materialise(grouped(docs, doc_id, text, size, percent))
    heads = groups.where("head IS NOT NULL").select(F.col("head.id").alias("_id"), F.col("head.key").alias("_key")).distinct()
    key, own = docs[f"`{doc_id}`"], text_key(docs, text)
    chosen = docs.join(heads, (key == F.col("_id")) & (own == F.col("_key")), "left_semi")
    twice = groups.where("head.id = id AND head.key = key").groupBy("id", "key").count().where("count > 1")
    if not twice.isEmpty():
        mark = fresh("_own", docs.columns)
        chosen = chosen.withColumn(mark, text_key(chosen, text)).dropDuplicates([doc_id, mark]).drop(mark)
    alone = groups.where("head IS NULL AND id IS NOT NULL").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    rest = docs.join(alone, (key == F.col("_id")) & (own == F.col("_key")), "left_semi")
    return chosen.unionByName(rest).unionByName(docs.where(key.isNull()))


def digest(docs: DataFrame) -> DataFrame:
    found = find_groups(docs, size=2)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
