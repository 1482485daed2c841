"""Column builders for positional n-grams, earth-mover cost and string distances; all run in the JVM.

Positions are normalised to [0, 1]. A padded word stands between the two sentinels ``START`` and ``END``.
Nulls give nulls, as in any SQL function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "\x02", "\x03"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def upto(n: Column) -> Column:
    """[0, 1, ..., n - 1]; empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def padded(word: Column) -> Column:
    return F.concat(F.lit(START), word, F.lit(END))


def num_grams(word: Column, n: int, list_rule: bool = True) -> Column:
    """Grams of a padded word: length + 3 - n.

    By ``list_rule`` a word counts length + 2 for n = 1 (although it has only length unpadded 1-grams), and the
    count may be negative; otherwise it is at least 0.
    """
    if list_rule:
        return F.length(word) + (3 - n if n > 1 else 2)
    return F.greatest(F.length(word) + 3 - n, F.lit(0))


def grams(word: Column, n: int, pad: bool | None = None) -> Column:
    """The n-grams of a word in order; by default padded for n > 1 only."""
    return let(padded(word) if (n > 1 if pad is None else pad) else word, lambda p: F.transform(upto(F.length(p) - (n - 1)), lambda i: F.substring(p, i + 1, F.lit(n))))


def text_grams(text: Column, n: int = 2) -> Column:
    return grams(text, n, pad=False)


def positions(of: Column, gram: Column) -> Column:
    """Where ``gram`` stands in the array ``of``, from 0 to 1."""
    last = F.greatest(F.size(of) - 1, F.lit(1))
    hits = F.filter(F.transform(of, lambda g, i: F.when(g == gram, i)), lambda i: i.isNotNull())
    return F.transform(hits, lambda i: i / last)


def emd_1d(xs: Column, ys: Column) -> Column:
    """Least cost to match two multisets of positions: the distance of matched ones, 1 for each other.

    Both are sorted here. Sets of equal size in [0, 1] are matched in order; the rest is a dynamic program over
    one row.
    """

    def cost(x: Column, y: Column) -> Column:
        paired = F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
        near = F.forall(F.concat(x, y), lambda v: (v >= 0) & (v <= 1))

        def row(prev: Column, a: Column) -> Column:
            start = F.struct(F.array(prev[0] + 1.0).alias("cur"), F.lit(1).alias("j"))

            def cell(s: Column, b: Column) -> Column:
                best = F.least(F.abs(a - b) + prev[s["j"] - 1], prev[s["j"]] + 1.0, s["cur"][s["j"] - 1] + 1.0)
                return F.struct(F.concat(s["cur"], F.array(best)).alias("cur"), (s["j"] + 1).alias("j"))

            return F.aggregate(y, start, cell, lambda s: s["cur"])

        table = F.aggregate(x, F.transform(F.sequence(F.lit(0), F.size(y)), lambda j: j.cast("double")), row)
        return F.when((F.size(x) == F.size(y)) & near, paired).otherwise(F.element_at(table, -1))

    sort = lambda a: F.array_sort(a.cast("array<double>"))
    return let(F.struct(sort(xs).alias("x"), sort(ys).alias("y")), lambda p: cost(p["x"], p["y"]))


def gram_similarity(xs: Column, ys: Column) -> Column:
    """What a shared gram adds to the similarity: the number of both positions, which lie in [0, 1], less their cost.

    Most grams stand once in a word; their cost is a difference, without sorting or a table.
    """
    single = (F.size(xs) == 1) & (F.size(ys) == 1)
    return F.when(single, F.lit(2.0) - F.abs(F.get(xs, 0) - F.get(ys, 0))).otherwise(F.size(xs) + F.size(ys) - emd_1d(xs, ys))


def profile(word: Column, n: int, pad: bool | None = None) -> Column:
    """Array of (gram, first, pos) of the distinct n-grams of a word, by their first places."""
    one = lambda all_: F.transform(F.array_distinct(all_), lambda g: F.struct(g.alias("gram"), F.array_position(all_, g).alias("first"), positions(all_, g).alias("pos")))
    return let(grams(word, n, pad), one)


def gram_map(profile_: Column) -> Column:
    """The positions of a profile's grams by gram."""
    return F.map_from_entries(F.transform(profile_, lambda g: F.struct(g["gram"], g["pos"])))


def shared_grams(profile_: Column, other: Column) -> Column:
    """Array of (first, x, y): the grams of a profile that another word's ``gram_map`` has too, in the profile's order."""
    found = F.transform(profile_, lambda g: F.struct(g["first"].alias("first"), g["pos"].alias("x"), F.try_element_at(other, g["gram"]).alias("y")))
    return F.filter(found, lambda g: g["y"].isNotNull())


def shared_similarity(shared: Column) -> Column:
    return F.aggregate(shared, F.lit(0.0), lambda s, g: s + gram_similarity(g["x"], g["y"]))


def gram_movers_distance(left: Column, right: Column, n: int = 2, invert: bool = False, normalize: bool = False) -> Column:
    """Distance (or, inverted, similarity) of two words by moving their n-grams.

    Normalised, both are shares of all grams; where neither word has any, the result is 0.
    Words may not hold the sentinels; such a row raises an error.
    """
    if not isinstance(n, int) or isinstance(n, bool):
        raise TypeError("n must be an integer")
    if n < 2:
        raise ValueError("n must be 2 or more")
    bad = F.contains(left, F.lit(START)) | F.contains(left, F.lit(END)) | F.contains(right, F.lit(START)) | F.contains(right, F.lit(END))

    def both(p: Column) -> Column:
        same = F.aggregate(F.array_intersect(p["a"], p["b"]), F.lit(0.0), lambda s, g: s + gram_similarity(positions(p["a"], g), positions(p["b"], g)))
        out = same if invert else p["total"] - same
        return F.when(p["total"] == 0, F.lit(0.0)).otherwise(out / p["total"]) if normalize else out.cast("double")

    parts = F.struct(grams(left, n).alias("a"), grams(right, n).alias("b"), (num_grams(left, n) + num_grams(right, n)).alias("total"))
    return F.when(left.isNull() | right.isNull(), F.lit(None).cast("double")).when(bad, F.raise_error(F.lit("a word holds a sentinel character")).cast("double")).otherwise(let(parts, both))


def power_mean(values: Column, dim: float) -> Column:
    if dim <= 0:
        raise ValueError("dim must be positive")
    return F.pow(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.pow(v, F.lit(float(dim)))) / F.size(values), F.lit(1.0 / dim))


def edit_distance(left: Column, right: Column) -> Column:
    return F.levenshtein(left, right)


def osa_distance(left: Column, right: Column) -> Column:
    """Optimal string alignment: Levenshtein with swaps of neighbours, no part being edited twice."""
    chars = lambda w: F.when(F.length(w) > 0, F.split(w, "")).otherwise(F.array().cast("array<string>"))

    def table(p: Column) -> Column:
        a, b = p["a"], p["b"]
        first = F.sequence(F.lit(0), F.size(b))

        def row(s: Column, i: Column) -> Column:
            # s: the row before the last one, and the last one
            def cell(cur: Column, j: Column) -> Column:
                swap = F.when((i > 1) & (j > 1) & (F.get(a, i - 1) == F.get(b, j - 2)) & (F.get(a, i - 2) == F.get(b, j - 1)), F.get(s["two"], j - 2) + 1)
                change = F.get(s["one"], j - 1) + (F.get(a, i - 1) != F.get(b, j - 1)).cast("int")
                return F.concat(cur, F.array(F.least(F.get(s["one"], j) + 1, F.element_at(cur, -1) + 1, change, swap)))

            line = F.aggregate(F.transform(upto(F.size(b)), lambda j: j + 1), F.array(i), cell)
            return F.struct(s["one"].alias("two"), line.alias("one"))

        return F.aggregate(F.transform(upto(F.size(a)), lambda i: i + 1), F.struct(first.alias("two"), first.alias("one")), row, lambda s: F.element_at(s["one"], -1))

    return F.when(left.isNull() | right.isNull(), F.lit(None).cast("int")).otherwise(let(F.struct(chars(left).alias("a"), chars(right).alias("b")), table))


def windows(items: Column, n: int) -> Column:
    """All runs of n neighbouring items."""
    return F.transform(upto(F.size(items) - (n - 1)), lambda i: F.slice(items, i + 1, n))


def sizes(n: int | Sequence[int]) -> tuple[int, ...]:
    """Gram sizes, sorted and each once."""
    out = (n,) if isinstance(n, int) else tuple(sorted({int(x) for x in n}))
    if not out or min(out) < 1:
        raise ValueError("gram sizes must be positive")
    return out
