"""Approximate dictionary lookup: an inverted index of positional n-grams as tables, queried in batches.

``GramIndex`` holds three tables: ``vocab`` (word_id, word), ``postings`` (n, gram, word_id, pos) and
``filters`` (gram, word_id). A batch of queries is one plan: candidates share a filter gram and are scored against
the grams of their words, made once for each word; without a filter, postings are joined on grams. Shared grams
add their similarity, sizes of grams are averaged by power mean, and windows rank per query. The index can be
written as Parquet and read again, and grows by ``add``; ``compact`` merges what was added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import END, START, emd_1d, gram_map, gram_movers_distance, gram_similarity, grams, profile, shared_grams, sizes
from ..functions.text import casefold
from ..plans.settle import numbered, salted_join, settled, spread, unused

SCORINGS = ("v3", "v5", "v5b", "v6")


def _postings(words: DataFrame, n_list: Sequence[int], *keep: str, pad: bool | None = None) -> DataFrame:
    """(*keep, n, gram, first, pos): a row for each distinct gram of each word and size; first is its first place."""

    def of(n: int) -> Column:
        return F.transform(profile(F.col("word"), n, pad), lambda g: F.struct(F.lit(n).alias("n"), g["gram"].alias("gram"), g["first"].alias("first"), g["pos"].alias("pos")))

    return words.select(*keep, F.explode(F.concat(*(of(n) for n in n_list))).alias("p")).select(*keep, "p.*")


def _checked(words: DataFrame) -> DataFrame:
    """Words may not be empty or hold a sentinel; nulls are left out."""
    w = F.col("word")
    bad = (w == "") | F.contains(w, F.lit(START)) | F.contains(w, F.lit(END))
    return words.filter(w.isNotNull()).withColumn("word", F.when(bad, F.raise_error(F.concat(F.lit("not a word: "), w)).cast("string")).otherwise(w))


class GramIndex:
    """A dictionary for approximate lookup; see ``build``."""

    def __init__(self, vocab: DataFrame, postings: DataFrame | None, filters: DataFrame | None, n: tuple[int, ...], case_sensitive: bool, filter_n: int) -> None:
        self.vocab_table, self._postings, self.filters = vocab, postings, filters
        self.ngram_sizes, self.case_sensitive, self.filter_ngram_size = n, case_sensitive, filter_n

    @classmethod
    def build(cls, words: DataFrame, word: str = "word", n: int | Sequence[int] = (2, 4), case_sensitive: bool = False, filter_n: int = 3, order: str | None = None) -> GramIndex:
        """An index of the distinct words of a column, case-folded unless ``case_sensitive``.

        Ids follow ``order``, the least of a word's rows, or else the words. ``filter_n`` = 0 makes every word
        that shares any gram a candidate.
        """
        n_list = sizes(n)
        if filter_n < 0:
            raise ValueError("filter_n must not be negative")
        given = words.select(F.col(word).alias("word"), (F.col(order) if order else F.lit(0)).alias("o"))
        given = given.groupBy("word").agg(F.min("o").alias("o"))  # each spelling is folded once
        given = _checked(given.withColumn("word", F.col("word") if case_sensitive else casefold(F.col("word"))))
        vocab = numbered(given.groupBy("word").agg(F.min("o").alias("o")), [F.col("o"), F.col("word")] if order else [F.col("word")], "word_id").select("word_id", "word")
        return cls._of(vocab, n_list, case_sensitive, filter_n)

    @classmethod
    def _of(cls, vocab: DataFrame, n_list: tuple[int, ...], case_sensitive: bool, filter_n: int) -> GramIndex:
        vocab = settled(vocab)
        filters = settled(vocab.select("word_id", F.explode(F.array_distinct(grams(F.col("word"), filter_n))).alias("gram"))) if filter_n else None
        return cls(vocab, None, filters, n_list, case_sensitive, filter_n)

    @property
    def postings(self) -> DataFrame:
        """(n, gram, word_id, pos, length), made when they are first asked for: lookups with a filter don't need them."""
        if self._postings is None:
            self._postings = settled(_postings(self.vocab_table, self.ngram_sizes, "word_id", "word").select("n", "gram", "word_id", "pos", F.length("word").alias("length")))
        return self._postings

    def _fold(self, words: DataFrame) -> DataFrame:
        return words if self.case_sensitive else words.withColumn("word", casefold(F.col("word")))

    def add(self, words: DataFrame, word: str = "word") -> GramIndex:
        """A new index with further words; ids so far stay, and words that it has are not added again."""
        given = self._fold(_checked(words.select(F.col(word).alias("word")))).distinct()
        fresh = given.join(self.vocab_table.select("word"), "word", "left_anti")
        start = (self.vocab_table.agg(F.max("word_id")).first()[0] if self.size() else -1) + 1
        more = GramIndex._of(numbered(fresh, [F.col("word")], "word_id", start).select("word_id", "word"), self.ngram_sizes, self.case_sensitive, self.filter_ngram_size)
        both = lambda a, b: a.unionByName(b) if a is not None else None
        return GramIndex(both(self.vocab_table, more.vocab_table), both(self._postings, None if self._postings is None else more.postings), both(self.filters, more.filters), self.ngram_sizes, self.case_sensitive, self.filter_ngram_size)

    def contains(self, words: DataFrame, word: str = "word") -> DataFrame:
        """Adds ``found`` to each row."""
        key, hit = unused(words, "_key", "_hit")
        folded = words.withColumn(key, F.col(word) if self.case_sensitive else casefold(F.col(word)))
        known = self.vocab_table.select(F.col("word").alias(key), F.lit(True).alias(hit))
        return folded.join(known, key, "left").withColumn("found", F.coalesce(hit, F.lit(False))).drop(key, hit)

    def compact(self) -> GramIndex:
        """The same index with each table written anew as one, after many calls of ``add``."""
        return GramIndex(settled(self.vocab_table), None if self._postings is None else settled(self._postings), None if self.filters is None else settled(self.filters), self.ngram_sizes, self.case_sensitive, self.filter_ngram_size)

    def size(self) -> int:
        return self.vocab_table.count()

    @property
    def vocabulary(self) -> DataFrame:
        """The words in order."""
        return self.vocab_table.select("word").orderBy("word")

    def save(self, path: str, buckets: int = 0) -> None:
        """As Parquet tables, postings sorted by gram so that row groups can be skipped by it."""
        self.vocab_table.write.mode("overwrite").parquet(f"{path}/vocab")
        self.postings.repartitionByRange(*([buckets] if buckets else []), "n", "gram").sortWithinPartitions("n", "gram").write.mode("overwrite").parquet(f"{path}/postings")
        if self.filters is not None:
            self.filters.write.mode("overwrite").parquet(f"{path}/filters")
        about = [(list(self.ngram_sizes), self.case_sensitive, self.filter_ngram_size)]
        self.vocab_table.sparkSession.createDataFrame(about, "n array<int>, case_sensitive boolean, filter_n int").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GramIndex:
        n, case_sensitive, filter_n = spark.read.parquet(f"{path}/about").first()
        return cls(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/filters") if filter_n else None, tuple(n), case_sensitive, filter_n)

    def lookup(self, queries: DataFrame, word: str = "query", top_k: int = 5, dim: float = 1, normalize: bool = False, scoring: str = "v6", invert: bool = True, prune: bool = False, id_col: str | None = None) -> DataFrame:
        """(qid, query, rank, word, score, sim2): the best words for each distinct query (or each ``id_col``), best first.

        * ``v6``: the best 2k by score, ranked again by score and the similarity by 2-grams, k rows.
        * ``v5``: up to 2k rows by score. With ``invert=False`` the score is a distance, 1 - score when
          normalised and -score otherwise, least first.
        * ``v5b``: k rows by score.
        * ``v3``: no filter; a shared gram adds the greater number of positions less the cost, by the query's
          gram count only; top_k of 0 or less gives all.

        Scores count as equal if they agree to 9 decimals; ties go to the word met first by size, then by place of
        the gram in the query, then to the smaller id. ``prune`` drops candidates that twice the sum of
        lesser gram counts shows to be out, before any cost is computed; results are the same.
        """
        if scoring not in SCORINGS:
            raise ValueError(f"scoring must be one of {SCORINGS}")
        if not dim > 0:
            raise ValueError("dim must be positive")
        if scoring != "v3" and top_k < 1:
            raise ValueError("top_k must be positive")
        v3 = scoring == "v3"
        asked = queries.select(F.col(word).alias("query"), *([F.col(id_col).alias("qid")] if id_col else [])).filter("query is not null").distinct()
        if not id_col:
            asked = asked.withColumn("qid", F.col("query"))
        folded = self._fold(_checked(asked.withColumnRenamed("query", "word").withColumn("query", F.col("word"))))
        if v3 or self.filters is None:
            scored = self._scored_by_join(folded, dim, normalize or v3, v3, 2 * top_k if prune and not v3 else 0)
        else:
            scored = self._scored_candidates(folded, dim, normalize, 2 * top_k if prune else 0)
        scored = scored.withColumn("score", F.round("score", 9))
        first = Window.partitionBy("qid").orderBy(F.desc("score"), "hit", "word_id")
        limit = {"v6": 2 * top_k, "v5": 2 * top_k, "v5b": top_k, "v3": top_k}[scoring]
        best = scored.withColumn("rank", F.row_number().over(first))
        best = best.filter(F.col("rank") <= limit) if limit > 0 else best
        best = best.join(self.vocab_table.withColumnRenamed("word", "found"), "word_id").join(folded.select("qid", "query", "word"), "qid")
        # the similarity by 2-grams is only needed for the few rows that are left
        sim2 = gram_movers_distance(F.col("word"), F.col("found"), 2, True, normalize or v3)
        best = best.withColumn("sim2", F.round(sim2, 9))
        if scoring == "v6":
            again = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("sim2"), "hit", "word_id")
            best = best.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= top_k)
        if not invert and not v3:
            best = best.withColumn("score", (1.0 if normalize else 0.0) - F.col("score"))
        return best.select("qid", "query", "rank", F.col("found").alias("word"), "score", "sim2")

    def _mean(self, values: Sequence[Column], dim: float) -> Column:
        """The power mean over sizes; sizes without a shared gram count as 0."""
        return F.pow(sum((F.pow(F.greatest(v, F.lit(0.0)), F.lit(float(dim))) for v in values), F.lit(0.0)) / len(self.ngram_sizes), F.lit(1.0 / dim))

    @staticmethod
    def _count(length: Column, n: int) -> Column:
        """Grams of a word, as scores count them."""
        return length + (3 - n if n > 1 else 2)

    def _scored_candidates(self, folded: DataFrame, dim: float, normalize: bool, bound: int) -> DataFrame:
        """(qid, word_id, score, hit) of the words that share a filter gram with a query, scored pair by pair.

        With ``bound``, words are left out whose greatest possible score is below the bound-th least possible one.
        """
        wanted = folded.select("qid", F.explode(F.array_distinct(grams(F.col("word"), self.filter_ngram_size))).alias("gram"))
        pairs = spread(salted_join(wanted, self.filters, ["gram"], "word_id").select("qid", "word_id").distinct(), "word_id")
        maps = self.vocab_table.select("word_id", F.length("word").alias("length"), *(gram_map(profile(F.col("word"), n)).alias(f"m{n}") for n in self.ngram_sizes))
        asked = folded.select("qid", F.length("word").alias("q_length"), *(profile(F.col("word"), n).alias(f"p{n}") for n in self.ngram_sizes))
        pairs = pairs.join(maps, "word_id").join(asked, "qid")
        shared = F.struct("q_length", "length", *(shared_grams(F.col(f"p{n}"), F.col(f"m{n}")).alias(f"s{n}") for n in self.ngram_sizes))
        some = lambda r: sum((F.size(r[f"s{n}"]) for n in self.ngram_sizes), F.lit(0)) > 0
        # exploded, so that the filter isn't pushed below and the grams compared twice
        pairs = pairs.select("qid", "word_id", F.explode(F.filter(F.array(shared), some)).alias("r")).select("qid", "word_id", "r.*")

        def mean(value) -> Column:
            sums = []
            for n in self.ngram_sizes:
                total = self._count(F.col("q_length"), n) + self._count(F.col("length"), n)
                same = F.aggregate(f"s{n}", F.lit(0.0), lambda s, g: s + value(g["x"], g["y"]))
                sums.append(F.when(total > 0, same / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0)) if normalize else same)
            return self._mean(sums, dim)

        if bound:
            fewer = lambda x, y: F.least(F.size(x), F.size(y)).cast("double")
            pairs = pairs.withColumns({"low": mean(fewer), "high": mean(lambda x, y: fewer(x, y) * 2)})
            # ranks up to the bound are seen, so its lower bound counts
            at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low"))) == bound
            bar = F.max(F.when(F.col("at"), F.col("low"))).over(Window.partitionBy("qid"))
            pairs = pairs.withColumn("at", at).withColumn("bar", bar).filter(F.col("bar").isNull() | (F.col("high") >= F.col("bar") - 1e-9))
        hits = [F.when(F.size(f"s{n}") > 0, F.struct(F.lit(n).alias("n"), F.get(f"s{n}", 0)["first"].alias("first"))) for n in self.ngram_sizes]
        return pairs.select("qid", "word_id", mean(gram_similarity).alias("score"), (F.least(*hits) if len(hits) > 1 else hits[0]).alias("hit"))

    def _scored_by_join(self, folded: DataFrame, dim: float, normalize: bool, v3: bool, bound: int) -> DataFrame:
        """The same of all words that share any gram, by a join of postings."""
        q = _postings(folded, self.ngram_sizes, "qid", "word").select("qid", "n", "gram", F.struct("n", "first").alias("hit"), F.col("pos").alias("x"), F.length("word").alias("q_length"))
        hits = salted_join(q, self.postings.withColumnRenamed("pos", "y"), ["n", "gram"], "word_id")
        own, other = (F.when(F.col("n") > 1, F.col(c) + 3 - F.col("n")).otherwise(F.col(c) + 2) for c in ("q_length", "length"))
        if v3:
            value, total = F.greatest(F.size("x"), F.size("y")) - emd_1d(F.col("x"), F.col("y")), own
        else:
            value, total = gram_similarity(F.col("x"), F.col("y")), own + other
        weight = F.when(total > 0, 1.0 / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0)) if normalize else F.lit(1.0)

        def mean(rows: DataFrame, v: Column, name: str) -> DataFrame:
            per_n = rows.groupBy("qid", "word_id", "n").agg(F.sum(v * weight).alias("s"), F.min("hit").alias("hit"))
            return per_n.groupBy("qid", "word_id").agg(F.pow(F.sum(F.pow(F.greatest("s", F.lit(0.0)), F.lit(float(dim)))) / len(self.ngram_sizes), F.lit(1.0 / dim)).alias(name), F.min("hit").alias("hit"))

        if bound:
            low = mean(hits, F.least(F.size("x"), F.size("y")), "low")
            high = mean(hits, F.least(F.size("x"), F.size("y")) * 2, "high").select("qid", "word_id", "high")
            at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low"))) == bound
            bar = low.withColumn("at", at).filter("at").select("qid", F.col("low").alias("bar"))
            kept = high.join(bar, "qid", "left").filter(F.col("bar").isNull() | (F.col("high") >= F.col("bar") - 1e-9)).select("qid", "word_id")
            hits = hits.join(kept, ["qid", "word_id"], "left_semi")
        return mean(hits, value, "score")
