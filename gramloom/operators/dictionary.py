"""Ranked dictionaries and lookups by edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pairs import weighted_edit_distance_udf
from ..plans.settle import numbered, settled, unused


class RankedDictionary:
    """Distinct words by their rank in code point order, with optional data (the least of a word's rows)."""

    def __init__(self, words: DataFrame, word: str = "word", data: str | None = None) -> None:
        given = words.select(F.col(word).alias("word"), (F.col(data) if data else F.lit(True)).alias("data")).filter("word is not null")
        self.table = settled(numbered(given.groupBy("word").agg(F.min("data").alias("data")), [F.col("word")], "rank").select("rank", "word", "data"))

    def index(self, words: DataFrame, word: str = "word") -> DataFrame:
        """Adds ``rank``: a word's rank, or -1; a column of that name is replaced."""
        return self._added(words, word, "word", "rank").withColumn("rank", F.coalesce("rank", F.lit(-1)))

    def _added(self, rows: DataFrame, column: str, key: str, value: str) -> DataFrame:
        rows = rows.drop(value) if value != column else rows
        (own,) = unused(rows, "_key")
        return rows.join(self.table.select(F.col(key).alias(own), value), F.col(column) == F.col(own), "left").drop(own)

    def lookup(self, words: DataFrame, word: str = "word") -> DataFrame:
        """Adds ``data``; null for words that are missing."""
        return self._added(words, word, "word", "data")

    def word_at(self, ranks: DataFrame, rank: str = "rank") -> DataFrame:
        """Adds ``word``; null for ranks out of range."""
        return self._added(ranks, rank, "rank", "word")

    def contains(self, words: DataFrame, word: str = "word") -> DataFrame:
        (own,) = unused(words, "_key")
        known = self.table.select(F.col("word").alias(own), F.lit(True).alias("found"))
        return words.drop("found").join(known, F.col(word) == F.col(own), "left").drop(own).withColumn("found", F.coalesce("found", F.lit(False)))

    def items(self) -> DataFrame:
        return self.table.orderBy("rank")

    def size(self) -> int:
        return self.table.count()

    def _states(self) -> DataFrame:
        """(a, b, n, letters): the states of the least automaton of all words, its start left out.

        Beginnings of words are one state if the same endings follow them; two hashes over all endings and their number
        stand for these, so that no task holds a state's endings. letters is the number of those that come next.
        """
        split = self.table.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.substring("word", F.lit(1), i).alias("head"), F.substring("word", i + 1, F.length("word")).alias("tail")))).alias("s")).select("s.*")
        head = split.groupBy("head").agg(F.bit_xor(F.xxhash64("tail")).alias("a"), F.bit_xor(F.xxhash64("tail", F.lit(1))).alias("b"), F.count("*").alias("n"), F.collect_set(F.when(F.col("tail") != "", F.substring("tail", 1, 1))).alias("letters"))
        return head.groupBy("a", "b", "n").agg(F.min(F.size("letters")).alias("letters"))

    def count_nodes(self) -> int:
        """States of the least automaton that knows just these words, without its start."""
        return self._states().count()

    def count_edges(self) -> int:
        """The steps that lead on from these states."""
        return self._states().agg(F.sum("letters")).first()[0] or 0

    def prefix(self, text: str) -> DataFrame:
        return self.table.filter(F.col("word").startswith(text)).orderBy("rank")

    def between(self, start: str | None = None, stop: str | None = None) -> DataFrame:
        """Words with start <= word < stop."""
        out = self.table
        out = out if start is None else out.filter(F.col("word") >= start)
        return (out if stop is None else out.filter(F.col("word") < stop)).orderBy("rank")


def within_edits(queries: DataFrame, words: DataFrame, k: int, query: str = "query", word: str = "word") -> DataFrame:
    """(query, word, distance) of all pairs within k insertions, deletions and substitutions.

    A word is cut into k + 1 parts; a query within k edits holds one of them unchanged, at most k places off.
    So both sides are joined on (length, number of the part, part) and only these pairs are measured.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    q = queries.select(F.col(query).alias("query")).filter("query is not null").distinct()
    w = words.select(F.col(word).alias("word")).filter("word is not null").distinct()
    if k == 0:
        return q.join(w, F.col("query") == F.col("word")).withColumn("distance", F.lit(0))
    begin = lambda length, i: F.floor(length * i / (k + 1)).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i")
    length = F.length("word")
    parts = w.select("word", length.alias("length"), number).select("word", "length", "i", F.substring("word", begin(F.col("length"), F.col("i")) + 1, begin(F.col("length"), F.col("i") + 1) - begin(F.col("length"), F.col("i"))).alias("part"))
    least = F.greatest(F.length("query") - k, F.lit(0))
    wanted = q.select("query", F.explode(F.sequence(least, F.length("query") + k)).alias("length")).select("query", "length", number)
    at, size = begin(F.col("length"), F.col("i")), begin(F.col("length"), F.col("i") + 1) - begin(F.col("length"), F.col("i"))
    lo, hi = F.greatest(at - k, F.lit(0)), F.least(at + k, F.length("query") - size)
    starts = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    wanted = wanted.select("query", "length", "i", size.alias("size"), F.explode(starts).alias("s")).select("query", "length", "i", F.substring("query", F.col("s") + 1, F.col("size")).alias("part")).distinct()
    pairs = wanted.join(parts, ["length", "i", "part"]).select("query", "word").distinct()
    return pairs.withColumn("distance", F.levenshtein("query", "word", k)).filter("distance >= 0")


def edit_lookup(queries: DataFrame, words: DataFrame, distance: float, insertion_cost: float = 1, deletion_cost: float = 1, substitution_cost: float = 1, transposition_cost: float = 2, query: str = "query", word: str = "word") -> DataFrame:
    """(query, word, distance): pairs within a weighted distance, swaps of neighbours included.

    Every edit costs at least the least cost (a swap is two edits), which bounds the number of edits. Swaps may be free.
    """
    if distance < 0 or min(insertion_cost, deletion_cost, substitution_cost, transposition_cost) < 0:
        raise ValueError("distance and costs must not be negative")
    costs = (insertion_cost, deletion_cost, substitution_cost, transposition_cost)
    if costs[:3] == (1, 1, 1) and transposition_cost >= 2:
        out = within_edits(queries, words, int(distance), query, word)
        return out.withColumn("distance", F.col("distance").cast("double"))
    least, swap = min(costs[:3]), transposition_cost / 2
    if not least:
        raise ValueError("insertions, deletions and substitutions must cost something, to bound their number")
    if transposition_cost >= least:
        pairs = within_edits(queries, words, int(distance / min(least, swap) + 1e-9), query, word)
    else:
        # swaps cost little or nothing: they don't change a word's sorted letters, and another edit changes two of them at most
        pairs = _within_sorted_edits(queries, words, 2 * int(distance / least + 1e-9), query, word)
    cost = weighted_edit_distance_udf(F.col("query"), F.col("word"), insertion=insertion_cost, deletion=deletion_cost, substitution=substitution_cost, transposition=transposition_cost)
    return pairs.withColumn("distance", cost).filter(F.col("distance") <= distance + 1e-9)


def _within_sorted_edits(queries: DataFrame, words: DataFrame, k: int, query: str, word: str) -> DataFrame:
    """(query, word) of the pairs whose sorted letters are within k edits."""
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "").alias("letters")
    q = queries.select(F.col(query).alias("query")).filter("query is not null").distinct().select("query", letters("query"))
    w = words.select(F.col(word).alias("word")).filter("word is not null").distinct().select("word", letters("word"))
    near = within_edits(q, w, k, "letters", "letters").select(F.col("query").alias("a"), F.col("word").alias("b"))
    return near.join(q.select("query", F.col("letters").alias("a")), "a").join(w.select("word", F.col("letters").alias("b")), "b").select("query", "word")


def find_all_matches(word: str, k: int, words: DataFrame, column: str = "word") -> DataFrame:
    """(word): the words within k edits of one word, in order."""
    query = words.sparkSession.createDataFrame([(word,)], "query string")
    return within_edits(query, words, k, "query", column).select("word").orderBy("word")
