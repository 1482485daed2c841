"""Similarity joins of words by moving n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import gram_map, gram_movers_distance, gram_similarity, grams, num_grams, profile, shared_grams, shared_similarity
from ..plans.settle import salted_join, spread, unused


def gram_table(words: DataFrame, word: str = "word", n: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(word, *keep, gram, pos): a row for each distinct gram of each row's word, with its sorted positions."""
    (each,) = unused(words, "_each")
    return words.select(word, *keep, F.explode(profile(F.col(word), n)).alias(each)).select(word, *keep, F.col(f"{each}.gram"), F.col(f"{each}.pos"))


def pair_scores(pairs: DataFrame, left: str, right: str, n: int = 2) -> DataFrame:
    """Adds similarity, distance and their normalised forms to pairs of words."""
    score = lambda invert, normalize: gram_movers_distance(F.col(left), F.col(right), n, invert, normalize)
    return pairs.withColumns({"similarity": score(True, False), "distance": score(False, False), "similarity_norm": score(True, True), "distance_norm": score(False, True)})


def shared_gram_similarity(left: DataFrame, right: DataFrame, n: int = 2, word: str = "word") -> DataFrame:
    """(left, right, similarity) of all pairs of distinct words that share a gram: a join on grams and a sum.

    All pairs are the result, so it grows with the square of a gram's words; see ``fuzzy_self_join`` for pairs above
    a threshold, which needs no such join.
    """
    a = gram_table(left.select(word).distinct(), word, n).select(F.col(word).alias("left"), "gram", F.col("pos").alias("x"))
    b = gram_table(right.select(word).distinct(), word, n).select(F.col(word).alias("right"), "gram", F.col("pos").alias("y"))
    return salted_join(a, b, ["gram"], "right").groupBy("left", "right").agg(F.sum(gram_similarity(F.col("x"), F.col("y"))).alias("similarity"))


def fuzzy_self_join(words: DataFrame, min_similarity: float, n: int = 2, word: str = "word") -> DataFrame:
    """(left, right, similarity), left < right, of distinct words with at least the normalised similarity.

    A shared gram adds at most twice the lesser of its numbers in both words, so a pair shares at least
    min_similarity * (N1 + N2) / 2 grams, and the lesser N is at least min_similarity / (2 - min_similarity)
    of the greater. With the grams of a word ordered by how many words have them, rare ones first, the pair
    then shares a gram among the first of either; only these are joined. Grams that most words have, such
    as a first letter, are thus hardly ever read. The first gram that a pair shares leaves it no more than the grams
    after it in either order, so pairs that meet too far back are left out before they are scored.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be over 0, and 1 at most")
    names = words.select(F.col(word).alias("w")).filter("w is not null").distinct().withColumn("n_grams", num_grams(F.col("w"), n)).filter("n_grams > 0")
    # the k-th gram of a kind within a word is a token of its own, so that shared grams are shared tokens
    nth = F.transform("_g", lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice("_g", 1, i + 1), lambda x: x == g)).alias("k")))
    each = names.withColumn("_g", grams(F.col("w"), n)).select("w", "n_grams", F.explode(nth).alias("t")).select("w", "n_grams", "t.gram", "t.k")
    freq = each.groupBy("gram", "k").agg(F.count("*").alias("freq")).filter("freq > 1")
    ratio = min_similarity / (2 - min_similarity)
    need = F.ceil(F.col("n_grams") * ratio - 1e-9)
    mine = each.join(freq, ["gram", "k"]).groupBy("w", "n_grams").agg(F.array_sort(F.collect_list(F.struct("freq", "gram", "k"))).alias("t"))
    # grams that no other word has come first in the order, but need no join
    first = F.slice("t", F.lit(1), F.greatest(F.lit(0), (F.size("t") - need + 1).cast("int")))
    tokens = mine.select("w", "n_grams", F.size("t").alias("rest"), F.posexplode(first).alias("i", "t")).select("w", "n_grams", (F.col("rest") - F.col("i")).alias("rest"), "t.gram", "t.k")
    a, b = (tokens.select(F.col("w").alias(c), F.col("n_grams").alias(f"n_{c}"), F.col("rest").alias(f"rest_{c}"), "gram", "k") for c in ("left", "right"))
    enough = F.least("rest_left", "rest_right") * 2 >= min_similarity * (F.col("n_left") + F.col("n_right")) - 1e-9
    near = enough & (F.least("n_left", "n_right") >= F.greatest("n_left", "n_right") * ratio - 1e-9) & (F.col("left") < F.col("right"))
    pairs = spread(a.join(b, ["gram", "k"]).filter(near).select("left", "right", "n_left", "n_right").distinct(), "left")
    # a word's grams and positions are made once, not for each pair
    known = names.select("w", profile(F.col("w"), n).alias("p"))
    pairs = pairs.join(known.select(F.col("w").alias("left"), "p"), "left").join(known.select(F.col("w").alias("right"), gram_map(F.col("p")).alias("m")), "right")
    score = shared_similarity(shared_grams(F.col("p"), F.col("m"))) / (F.col("n_left") + F.col("n_right"))
    # exploded, so that the filter isn't pushed below and the score computed twice
    return pairs.select("left", "right", F.explode(F.filter(F.array(score), lambda x: x >= min_similarity - 1e-9)).alias("similarity"))
