"""A set of words with approximate search, as tables; sets are values, so changes give a new set."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import gram_map, grams, profile, shared_grams, shared_similarity, sizes
from ..functions.text import casefold, normalize_nfc
from ..plans.settle import numbered, salted_join, settled, spread, unused


class WordSet:
    """Words by their normal form (case folding, then ``unicode_normalizer``), in their original spelling.

    ``unicode_normalizer`` is a column function such as ``functions.text.normalize_nfc``, or None. Of words
    with one normal form, the one with the least original spelling is kept, or the one that was there first.
    """

    def __init__(self, words: DataFrame, word: str = "word", *, case_sensitive: bool = False, unicode_normalizer: Callable[[Column], Column] | None = normalize_nfc, ngram_sizes: int | Sequence[int] = (2, 3, 4), _members: DataFrame | None = None) -> None:
        if not isinstance(case_sensitive, bool):
            raise TypeError("case_sensitive must be a boolean")
        if unicode_normalizer is not None and not callable(unicode_normalizer):
            raise TypeError("unicode_normalizer must be callable or None")
        self.case_sensitive, self.unicode_normalizer, self.ngram_sizes = case_sensitive, unicode_normalizer, sizes(ngram_sizes)
        #: The size of the grams of which a candidate must share one; None if every word is a candidate.
        self.filter_n = 3 if 3 in self.ngram_sizes else self.ngram_sizes[0] if self.ngram_sizes[0] <= 4 else None
        self.members = _members if _members is not None else settled(self._numbered(self._normal(words, word), 0))
        self._filters: DataFrame | None = None

    def _normal(self, words: DataFrame, word: str = "word") -> DataFrame:
        """(norm, original), each normal form once; empty words and words with a NUL raise an error."""
        norm = F.col("original") if self.case_sensitive else casefold(F.col("original"))
        if self.unicode_normalizer is not None:
            norm = self.unicode_normalizer(norm)
        out = words.select(F.col(word).alias("original")).filter("original is not null").withColumn("norm", norm)
        bad = (F.col("norm") == "") | F.contains("norm", F.lit("\0"))
        out = out.withColumn("norm", F.when(bad, F.raise_error(F.lit("a word is empty or holds a NUL")).cast("string")).otherwise(F.col("norm")))
        return out.groupBy("norm").agg(F.min("original").alias("original"))

    def _numbered(self, normal: DataFrame, start: int) -> DataFrame:
        return numbered(normal, [F.col("original")], "word_id", start).select("word_id", "norm", "original")

    def _with(self, members: DataFrame) -> WordSet:
        return WordSet(members, case_sensitive=self.case_sensitive, unicode_normalizer=self.unicode_normalizer, ngram_sizes=self.ngram_sizes, _members=settled(members))

    def _next_id(self) -> int:
        last = self.members.agg(F.max("word_id")).first()[0]
        return 0 if last is None else last + 1

    def add(self, words: DataFrame, word: str = "word") -> WordSet:
        fresh = self._normal(words, word).join(self.members.select("norm"), "norm", "left_anti")
        return self._with(self.members.unionByName(self._numbered(fresh, self._next_id())))

    union = add

    def discard(self, words: DataFrame, word: str = "word") -> WordSet:
        return self._with(self.members.join(self._normal(words, word).select("norm"), "norm", "left_anti"))

    difference = discard

    def remove(self, words: DataFrame, word: str = "word") -> WordSet:
        """Like ``discard``, but every word must be there."""
        missing = self._normal(words, word).join(self.members.select("norm"), "norm", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0]["original"])
        return self.discard(words, word)

    def clear(self) -> WordSet:
        return self._with(self.members.limit(0))

    def intersection(self, words: DataFrame, word: str = "word") -> WordSet:
        return self._with(self.members.join(self._normal(words, word).select("norm"), "norm", "left_semi"))

    def symmetric_difference(self, words: DataFrame, word: str = "word") -> WordSet:
        return self.discard(words, word).add(self._normal(words, word).join(self.members.select("norm"), "norm", "left_anti"), "original")

    def isdisjoint(self, words: DataFrame, word: str = "word") -> bool:
        return not self.members.join(self._normal(words, word).select("norm"), "norm", "left_semi").limit(1).count()

    def issubset(self, words: DataFrame, word: str = "word") -> bool:
        return not self.members.join(self._normal(words, word).select("norm"), "norm", "left_anti").limit(1).count()

    def issuperset(self, words: DataFrame, word: str = "word") -> bool:
        return not self._normal(words, word).join(self.members.select("norm"), "norm", "left_anti").limit(1).count()

    def equals(self, words: DataFrame, word: str = "word") -> bool:
        return self.issubset(words, word) and self.issuperset(words, word)

    def pop(self) -> tuple[str, WordSet]:
        """The word with the smallest id, and the set without it."""
        first = self.members.orderBy("word_id").limit(1).collect()
        if not first:
            raise KeyError("the set is empty")
        return first[0]["original"], self._with(self.members.filter(F.col("word_id") != first[0]["word_id"]))

    def contains(self, words: DataFrame, word: str = "word") -> DataFrame:
        """Adds ``found`` to each row."""
        norm = F.col(word) if self.case_sensitive else casefold(F.col(word))
        if self.unicode_normalizer is not None:
            norm = self.unicode_normalizer(norm)
        key, hit = unused(words, "_key", "_hit")
        known = self.members.select(F.col("norm").alias(key), F.lit(True).alias(hit))
        return words.withColumn(key, norm).join(known, key, "left").withColumn("found", F.coalesce(hit, F.lit(False))).drop(key, hit)

    def size(self) -> int:
        return self.members.count()

    def __len__(self) -> int:
        return self.size()

    def words(self) -> DataFrame:
        """The members in their original spelling, in the order of their ids."""
        return self.members.select(F.col("original").alias("word"), "word_id").orderBy("word_id").select("word")

    def __repr__(self) -> str:
        return f"WordSet(ngram_sizes={self.ngram_sizes}, case_sensitive={self.case_sensitive})"

    def find_similar(self, queries: DataFrame, word: str = "query", k: int = 5, min_similarity: float | None = None) -> DataFrame:
        """(query, rank, word, similarity): the k most similar words of each distinct query, best first, ties by id.

        The similarity is the sum over the grams of all sizes, divided by the number of grams of both words,
        between 0 and 1. A query that is empty, or too short to have a filter gram, has no rows.
        """
        if not isinstance(k, int) or k < 1:
            raise ValueError("k must be a positive integer")
        if min_similarity is not None and not 0 <= min_similarity <= 1:
            raise ValueError("min_similarity must be between 0 and 1")
        n_list = self.ngram_sizes
        asked = queries.select(F.col(word).alias("query")).filter("query <> ''").distinct()
        norm = F.col("query") if self.case_sensitive else casefold(F.col("query"))
        if self.unicode_normalizer is not None:
            norm = self.unicode_normalizer(norm)
        asked = asked.withColumn("word", norm).filter("word <> ''")
        count = lambda length: sum((F.greatest(length + 3 - n, F.lit(0)) for n in n_list), F.lit(0))
        # candidates share a gram of the filter's size, or else any gram; the grams of a word are made once, not for each pair
        met = (self.filter_n,) if self.filter_n else n_list
        one = lambda w, n: F.transform(F.array_distinct(grams(F.col(w), n, True)), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
        each = lambda w: F.explode(F.concat(*(one(w, n) for n in met))).alias("g")
        if self._filters is None:
            self._filters = settled(self.members.select("word_id", each("norm")))
        pairs = spread(salted_join(asked.select("query", each("word")), self._filters, ["g"], "word_id").select("query", "word_id").distinct(), "word_id")
        maps = self.members.select("word_id", F.length("norm").alias("length"), *(gram_map(profile(F.col("norm"), n, True)).alias(f"m{n}") for n in n_list))
        mine = asked.select("query", F.length("word").alias("q_length"), *(profile(F.col("word"), n, True).alias(f"p{n}") for n in n_list))
        pairs = pairs.join(maps, "word_id").join(mine, "query")
        same = sum((shared_similarity(shared_grams(F.col(f"p{n}"), F.col(f"m{n}"))) for n in n_list), F.lit(0.0))
        # exploded, so that filters aren't pushed below and the sum computed again
        scored = pairs.select("query", "q_length", "word_id", "length", F.explode(F.array(same)).alias("s"))
        if not self.filter_n:
            # without a filter every word counts, with a similarity of 0 if it shares nothing
            shared = scored.select("query", "word_id")
            rest = asked.select("query", F.length("word").alias("q_length"))
            few = self.members.orderBy("word_id").limit(k)  # no more of them can be among the first k
            scored = scored.unionByName(rest.join(F.broadcast(few.select("word_id", F.length("norm").alias("length"))), F.lit(True)).join(shared, ["query", "word_id"], "left_anti").withColumn("s", F.lit(0.0)))
        scored = scored.withColumn("total", count(F.col("q_length")) + count(F.col("length"))).filter("total > 0")
        scored = scored.withColumn("similarity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / F.col("total"))), 9))
        if min_similarity is not None:
            scored = scored.filter(F.col("similarity") >= min_similarity)
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "word_id"))).filter(F.col("rank") <= k)
        return best.join(self.members.select("word_id", F.col("original").alias("word")), "word_id").select("query", "rank", "word", "similarity")

    def suggest(self, queries: DataFrame, word: str = "query", k: int = 5) -> DataFrame:
        """(query, rank, word) of ``find_similar``."""
        return self.find_similar(queries, word, k).select("query", "rank", "word")

