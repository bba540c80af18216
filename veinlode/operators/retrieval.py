"""Keyword and tag retrieval, and checks that answers are grounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import words
from ..sources.store import cut

# Words that the chat retriever doesn't count.
STOPWORDS = (
    "a an the is are was were be been of to in on for and or with by at as it its this that these those what which who whom why how "
    "does do did can could would should will i me my we our you your about from into than then there their them they has have had not "
    "no yes so if but"
).split()
# Fixed value: a citation in an answer.
CITATION = r"\[([a-z]+:[^\]\s]+|dataset)\]"
# What counts as a number in an answer that is held against an attribution, and against cards.
CLAIM = r"(?<![\w.])-?\d+(?:\.\d+)?(?!\w|\.\d)"
CARD_CLAIM = r"(?<![\w.#/-])[-+]?\d+(?:\.\d+)?%?(?![\w/])"


def tokens(text: Column, stop: bool) -> Column:
    """SX27."""
    return F.filter(words(text), lambda w: ~w.isin(STOPWORDS)) if stop else words(text)


def has_words(text: Column, phrase: str) -> Column:
    """SX29: whether a phrase stands in the text between other characters than letters, digits and underscores, without case."""
    escaped = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in phrase.lower())
    return F.coalesce(F.lower(text).rlike(rf"(?<![a-z0-9_]){escaped}(?![a-z0-9_])"), F.lit(False))


def index(cards: DataFrame, key: str, text: str, stop: bool = False) -> DataFrame:
    """SX28: (key, token, tf, length); a card without tokens has no row."""
    t = cards.select(key, tokens(F.col(text), stop).alias("_t"))
    rows = t.select(key, F.size("_t").alias("length"), F.explode("_t").alias("token"))
    return rows.groupBy(key, "length", "token").agg(F.count("*").alias("tf"))


def bm25(cards: DataFrame, queries: DataFrame, card: str, query: str, text: str, k1: float = 1.2, b: float = 0.75, stop: bool = False, distinct: bool = True) -> DataFrame:
    """XR12, XR13: (query, card, score) of cards that share a token with the query.

    ``distinct``: a query's tokens count once (the signature retriever) or as often as it has them (the chat
    retriever). The join is by token; only matching tokens of the index move.
    """
    t = cut(index(cards, card, text, stop))  # read for terms, lengths and matches: tokenised once
    n = cards.agg(F.count("*").alias("n")).crossJoin(t.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")))  # one row each
    df = t.groupBy("token").agg(F.count("*").alias("df"))
    q = queries.select(query, F.explode(tokens(F.col(text), stop)).alias("token")).groupBy(query, "token").agg(F.count("*").alias("qn"))
    terms = q.join(df, "token").crossJoin(F.broadcast(n))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.select(query, "token", (idf * (F.lit(1) if distinct else F.col("qn"))).alias("w"), (F.col("words") / F.col("n")).alias("mean"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return terms.join(t, "token").groupBy(query, card).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, query: str, card: str, k: int) -> DataFrame:
    """XR15: the k best cards of each query; ties by id."""
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), card)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_signature(tags: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """XR14: (sample, card_id, score, rank) from (sample, tag, weight) and cards with arrays of tags and relations.

    A card scores its tags' weights, and 0.03 more for each relation that is also a tag of the sample.
    """
    long = cards.select("card_id", F.explode(F.array_distinct("graph_signals")).alias("tag"), F.lit(True).alias("signal")).union(
        cards.select("card_id", F.explode(F.array_distinct("relations")).alias("tag"), F.lit(False).alias("signal"))
    )
    score = F.sum(F.when(F.col("signal"), F.col("weight")).otherwise(0.03)).alias("score")
    return top_k(tags.join(long, "tag").groupBy("sample", "card_id").agg(score), "sample", "card_id", k)


def normalised_weights(tags: DataFrame) -> DataFrame:
    """AG06, XR11: weights of a sample's tags, adding up to 1, to 12 decimals."""
    s = tags.groupBy("sample", "tag").agg(F.sum("weight").alias("w"))
    return s.select("sample", "tag", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("sample")), 12).alias("weight"))


def mentioned_numbers(text: Column) -> Column:
    """XR17: numbers after # in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#(\d+)"), F.lit(1)))


def numbers(text: Column, pattern: str = CLAIM) -> Column:
    """Numbers in a text, as strings, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def places(number: Column) -> Column:
    return F.length(F.regexp_extract(number, r"\.(\d+)", 1))


def supported(number: Column, values: Column) -> Column:
    """SF22: a value lies within half a unit of the number's last place."""
    half = F.lit(0.5) / F.pow(F.lit(10.0), places(number)) + 1e-12
    return F.exists(values, lambda v: F.abs(v - number.cast("double")) <= half)


def unsupported(answer: Column, values: Column, pattern: str = CLAIM) -> Column:
    """XR18: the answer's numbers that no value supports."""
    return F.filter(numbers(answer, pattern), lambda n: ~supported(n, values))


def card_supported(number: Column, values: Column) -> Column:
    """SF23: small whole numbers, a card's number, one that it shortens, or its percentage."""
    plain = F.regexp_replace(number, "%$", "").cast("double")
    size, n = F.abs(plain), places(number)

    def fits(value: Column, digits: Column) -> Column:
        unit = F.pow(F.lit(10.0), digits)
        shortened = (value != 0) & (digits >= 1)
        return F.exists(values, lambda v: (F.abs(value - F.abs(v)) <= 1e-9) | (shortened & (F.rint(F.abs(v) * unit) == F.rint(value * unit))))

    small = (size <= 10) & (plain == F.rint(plain))
    return small | fits(size, n) | (number.endswith("%") & fits(size / 100, n + 2))


def check_answer(text: Column, cards: Column, values: Column) -> dict[str, Column]:
    """XR19: citations in square brackets that aren't among the cards' ids, and numbers that no card supports."""
    cited = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)))
    rest = F.regexp_replace(text, CITATION, " ")
    wrong = F.filter(numbers(rest, CARD_CLAIM), lambda n: ~card_supported(n, values))
    return {"citations": cited, "unknown_citations": F.array_except(cited, cards), "unsupported_numbers": wrong}
