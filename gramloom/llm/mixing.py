"""Mixing sources to target weights, in DataFrame functions: exact block quotas, split over shards by a tree.

A source's documents, one after another, are a stream of words, cut into blocks of equal length. A source
takes every block of a full epoch, and a quota of the blocks of one more, so its words come within half a
block of its target (a block is a word, or at most 1/1024 of the source). Which blocks these are, and where they go,
follows a keyed permutation of the source's block numbers (a Feistel network over a x b >= n with cycle
walking), so nothing is sorted or held in one place: rank = permutation(block), taken if rank < quota.

The quotas of all sources are split over the output shards by a binary tree: a node's left child gets
the number of blocks its shards hold, drawn from the node's sources by a multivariate hypergeometric
distribution (a chain of univariate draws, each by inversion from its mode, or by the normal quantile where
its standard deviation exceeds ``WIDE``). So each shard has an exact quota of each source, its ranks are
an interval of their own of the source's permutation, and ``mixed`` shuffles within the shard only: a shard
is written in slices, by the first bits of its parts' shuffled order, so that no task sorts more than about
``SHARD_WORDS`` words.

Word offsets in a stream come from two levels of sums: within buckets of about ``BUCKET`` rows, and over
the buckets of a source; a source with a third of all rows has many buckets. Rows are dealt to buckets by their id;
rows of an id (or of none) that at least 1/1000 of all rows have are dealt singly. The one global order is over
sources, which have a row each; a tree node holds one number for each source.

Defined results: null text has size 0 and takes nothing; a null source is a source of its own, the last;
rows with the same id are rows of their own; an empty table gives an empty result; columns other than the
named ones are ignored. The seed fixes all draws, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import HEAVY, Store, lookup_join, table, unused, utf8

#: Fixed values of the contract: weights by rank, share of all sizes, and the cap in times of a source's size.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BLOCK, LEAST_BLOCKS, BUCKET, WIDE, SHARD_WORDS, MAX_SHARDS, TASK_ROWS = 128, 1024, 1024, 50.0, 1 << 20, 4096, 50_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", uid: Column | None = None) -> DataFrame:
    """(uid, doc_id, skey, size): a row for each row; skey is the source, marked so that null is a key."""
    return df.select(
        (F.monotonically_increasing_id() if uid is None else uid).alias("uid"),
        F.col(id_col).alias("doc_id"),
        F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("skey"),
        F.regexp_count(utf8(F.col(text_col)), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row for each source: its size, its number of rows, and its target, levelled so that none is above the cap.

    Resharing the excess until none is above ends at min(cap, level * weight); the level is found in one
    pass over the sources by cap / weight.
    """
    total = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("skey") == "n", "skey")
    ranked = total.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * cap).cast("double"))
    w = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole).cast("double") * share
    # were all sources before this one at their caps, the rest would reach this level
    ranked = ranked.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    ranked = ranked.withColumn("fits", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "rank", "level"))).over(whole)["level"])
    return ranked.select("skey", "source_size", "rows", "rank", "w", F.least("cap", F.coalesce(F.col("fits") * F.col("w"), F.col("cap"))).alias("target"))


def quotas(targeted: DataFrame) -> DataFrame:
    """Adds each source's block length, number of blocks, quota of blocks over all epochs, and number of buckets."""
    out = targeted.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.round((F.col("target") - full * F.col("source_size")) / F.col("block")).cast("long")
    out = out.withColumn("quota", full * F.col("blocks") + F.greatest(F.lit(0), F.least(part, F.col("blocks"))))
    return out.withColumn("buckets", F.ceil(F.col("rows") / BUCKET).cast("long"))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    small = F.element_at(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16))), F.least(n, F.lit(15)).cast("int") + 1)
    series = x * F.log(F.greatest(x, F.lit(1.0))) - x + 0.5 * F.log(F.greatest(x, F.lit(1.0)) * (2 * math.pi)) + 1 / (12 * F.greatest(x, F.lit(1.0))) - 1 / (360 * F.pow(F.greatest(x, F.lit(1.0)), F.lit(3.0)))
    return F.when(n <= 15, small).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _uniform(*key: Column) -> Column:
    """In (0, 1), fixed by the key."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, and written once in the expression."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(good: Column, bad: Column, draws: Column, *key: Column) -> Column:
    """The number of good ones among ``draws`` drawn without replacement; the key fixes the draw."""
    one = F.lit(1).cast("long")
    given = F.struct(good.cast("long").alias("good"), bad.cast("long").alias("bad"), draws.cast("long").alias("draws"), *(_uniform(F.lit(k), *key).alias(f"u{k}") for k in (1, 2, 3)))

    def bounds(g: Column) -> Column:
        n = g["good"] + g["bad"]
        share = F.when(n > 0, g["draws"] / F.greatest(n, one)).otherwise(F.lit(0.0))
        mean = g["good"] * share
        return F.struct(
            g.alias("g"),
            F.greatest(F.lit(0), g["draws"] - g["bad"]).cast("long").alias("low"),
            F.least(g["good"], g["draws"]).alias("high"),
            mean.alias("mean"),
            F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * g["bad"] / F.greatest(n - 1, one))).alias("sd"),
            F.floor((g["draws"] + 1.0) * (g["good"] + 1.0) / (n + 2.0)).cast("long").alias("middle"),
        )

    def draw(b: Column) -> Column:
        z = F.sqrt(-2 * F.log(b["g"]["u1"])) * F.cos(2 * math.pi * b["g"]["u2"])
        wide = F.greatest(b["low"], F.least(b["high"], F.round(b["mean"] + b["sd"] * z).cast("long")))
        return F.when(b["low"] >= b["high"], b["high"]).when(b["sd"] > WIDE, wide).otherwise(_let(F.greatest(b["low"], F.least(b["high"], b["middle"])), lambda mode: _outward(b, mode)))

    return _let(_let(given, bounds), draw).cast("long")


def _outward(b: Column, mode: Column) -> Column:
    """Inversion from the mode: the values above and below it in turn, until their probabilities reach u3."""
    good, bad, draws, low, high = b["g"]["good"], b["g"]["bad"], b["g"]["draws"], b["low"], b["high"]
    top = F.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    reach = F.greatest(F.least(F.greatest(mode - low, high - mode), F.ceil(b["sd"] * 14 + 14)), F.lit(1)).cast("int")
    init = _let(top, lambda t: F.struct((b["g"]["u3"] - t).alias("u"), mode.alias("at"), mode.alias("up"), t.alias("p_up"), mode.alias("down"), t.alias("p_down")))

    def step(a: Column, _: Column) -> Column:
        k, j = a["up"], a["down"]
        more = F.when(k < high, a["p_up"] * ((good - k) * (draws - k) / ((k + 1.0) * (bad - draws + k + 1.0)))).otherwise(F.lit(0.0))
        less = F.when(j > low, a["p_down"] * (j * (bad - draws + j) / ((good - j + 1.0) * (draws - j + 1.0)))).otherwise(F.lit(0.0))

        def settle(p: Column) -> Column:
            u1 = a["u"] - p["more"]
            at = F.when(u1 < 0, k + 1).when(u1 - p["less"] < 0, j - 1).otherwise(a["at"])
            u = F.when(u1 < 0, u1).otherwise(u1 - p["less"])
            return F.struct(u.alias("u"), at.alias("at"), F.least(k + 1, high).alias("up"), p["more"].alias("p_up"), F.greatest(j - 1, low).alias("down"), p["less"].alias("p_down"))

        return F.when(a["u"] < 0, a).otherwise(_let(F.struct(more.alias("more"), less.alias("less")), settle))

    return F.aggregate(F.sequence(F.lit(1), reach), init, step, lambda a: a["at"])


def _chain(seed: int, depth: int):
    """A step of the chain of draws over a node's sources."""

    def step(a: Column, x: Column) -> Column:
        got = hypergeometric(x, a["rest"] - x, a["draws"], F.lit(seed), F.lit(depth), F.col("first"), F.size(a["left"]))
        return _let(got, lambda g: F.struct((a["draws"] - g).alias("draws"), (a["rest"] - x).alias("rest"), F.concat(a["left"], F.array(g)).alias("left")))

    return step


def splitting_tree(sources: DataFrame, shards: int, seed: int, store: Store) -> DataFrame:
    """(skey, bounds): for each source the ranks at which the shards' intervals end, in shard order."""
    order = F.sort_array(F.collect_list(F.struct("rank", "skey", "quota")))
    node = sources.agg(order.alias("s")).select(
        F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("n"), F.transform("s", lambda x: x["quota"]).alias("q"), F.transform("s", lambda x: x["skey"]).alias("keys")
    )
    for depth in range(int(math.log2(shards))):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        node = node.withColumn("total", total)
        draws = F.floor(F.col("total") / 2) + F.when(F.col("total") % 2 == 1, F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), "first"), F.lit(2))).otherwise(F.lit(0))
        init = F.struct(draws.cast("long").alias("draws"), F.col("total").alias("rest"), F.array().cast("array<bigint>").alias("left"))

        node = node.withColumn("left", F.aggregate("q", init, _chain(seed, depth), lambda a: a["left"]))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        both = F.array(F.struct(F.col("first").alias("first"), F.col("left").alias("q")), F.struct((F.col("first") + F.col("n") / 2).cast("long").alias("first"), right.alias("q")))
        node = node.select(F.explode(both).alias("c"), (F.col("n") / 2).cast("long").alias("n"), "keys").select("c.first", "n", "c.q", "keys")
        if depth % 4 == 3:
            node = store.keep(node, f"tree{depth}")
    leaf = node.select("first", F.explode(F.arrays_zip(F.col("keys").alias("skey"), F.col("q").alias("got")))).select("first", F.col("col.skey").alias("skey"), F.col("col.got").alias("got"))
    counts = leaf.groupBy("skey").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "got"))), lambda x: x["got"]).alias("got"))
    init = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return counts.select("skey", F.aggregate("got", init, lambda a, g: F.struct((a["sum"] + g).alias("sum"), F.concat(a["out"], F.array(a["sum"] + g)).alias("out")), lambda a: a["out"]).alias("bounds"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. n - 1, without a table."""

    def over(p: Column) -> Column:
        n, a, b, key = p["n"], p["a"], p["b"], p["key"]

        def once(y: Column) -> Column:
            def round_(s: Column, r: Column) -> Column:
                left = F.pmod(s["l"] + F.pmod(F.xxhash64(key, r, s["r"]), a), a)
                return _let(left, lambda v: F.struct(v.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(key, -r, v), b), b).alias("r")))

            start = F.struct((y / b).cast("long").alias("l"), (y % b).alias("r"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, round_, lambda s: s["l"] * b + s["r"])

        # of the a * b numbers fewer than a are no block, so a walk of that many steps and one more ends on a block
        walk = lambda y, steps: F.aggregate(F.sequence(F.lit(0), steps), y, lambda v, i: F.when((i > 0) & (v < n), v).otherwise(once(v)))
        few = walk(p["x"], F.least(p["holes"], F.lit(4)))
        # a few steps nearly always do
        return _let(few, lambda y: F.when(y < n, y).otherwise(F.aggregate(F.sequence(F.lit(0), p["holes"]), y, lambda v, _: F.when(v < n, v).otherwise(once(v)))))

    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    sides = _let(a, lambda a: F.struct(x.alias("x"), n.alias("n"), key.alias("key"), a.alias("a"), F.greatest(F.ceil(n / a), F.lit(1)).cast("long").alias("b")))
    full = _let(sides, lambda s: F.struct(s["x"].alias("x"), s["n"].alias("n"), s["key"].alias("key"), s["a"].alias("a"), s["b"].alias("b"), (s["a"] * s["b"] - s["n"]).cast("int").alias("holes")))
    return _let(full, over)


def taken_blocks(sizes: DataFrame, store: Store, seed: int = 17, shards: int | None = None) -> DataFrame:
    """(uid, doc_id, size, source_size, target, parts): parts are the pieces of the document's words that the mix takes.

    A part has the epoch, the first word and the number of words within the document, the shard and the rank
    in the source's permutation; a block's part has the words of the block that lie in the document.
    """
    sources = store.keep(quotas(targets(sizes)), "sources")
    counted = sources.agg(F.sum("rows"), F.sum(F.col("quota") * F.col("block"))).first()
    total = counted[0] or 0
    if shards is None:
        shards = min(MAX_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, (counted[1] or 0) / SHARD_WORDS)))))
    plan = store.keep(sources.join(splitting_tree(sources, shards, seed, store), "skey"), "plan")
    rows = lookup_join(sizes, plan.drop("bounds"), ["skey"], "rows", total)
    # at most HEAVY ids
    often = store.keep(sizes.groupBy(F.col("doc_id").alias("often")).agg(F.count("*").alias("n")).filter(F.col("n") >= max(total // HEAVY, 64)).select("often", F.lit(True).alias("single")), "often")
    rows = rows.join(F.broadcast(often), F.col("doc_id").eqNullSafe(F.col("often")), "left")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.when(F.col("single"), F.col("uid")), F.lit(seed)), F.col("buckets"))).drop("often", "single")
    # dealt by an explicit number of tasks: the work is in the expressions, not in the bytes
    tasks = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    rows = store.keep(rows, "rows")
    over = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(over), F.lit(0))).select("skey", "bucket", "base")
    within = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.repartition(tasks, "skey", "bucket").withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base.repartition(tasks, "skey", "bucket"), ["skey", "bucket"]).withColumn("at", F.col("base") + F.col("own")).drop("own", "base", "bucket")
    placed = lookup_join(placed, plan.select("skey", "bounds", F.col("rows").alias("n")), ["skey"], "n", total).drop("n")
    n, length = F.col("blocks"), F.col("block")
    epochs = F.when(n > 0, F.ceil(F.col("quota") / F.greatest(n, F.lit(1)))).otherwise(F.lit(0)).cast("int")
    first, last = (F.col("at") / length).cast("long"), ((F.col("at") + F.col("size") - 1) / length).cast("long")
    ends = F.col("bounds")

    def shard(p: Column) -> Column:
        init = F.struct(F.lit(0).alias("lo"), F.lit(shards - 1).alias("hi"))
        half = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(ends[half(s)] > p, F.struct(s["lo"].alias("lo"), half(s).alias("hi"))).otherwise(F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(max(1, math.ceil(math.log2(shards)) + 1))), init, step, lambda s: s["lo"])

    def parts_of(epoch: Column) -> Column:
        def part(block: Column) -> Column:
            start = F.greatest(block * length, F.col("at"))
            end = F.least((block + 1) * length, F.col("at") + F.col("size"))
            # an epoch that is taken whole has all ranks, the last one those below the quota
            rank = permuted(block, n, F.xxhash64(F.lit(seed), "rank", epoch)) + epoch * n
            return F.struct(epoch.alias("epoch"), (start - F.col("at")).alias("start"), (end - start).alias("length"), rank.alias("rank"))

        return F.filter(F.transform(F.sequence(first, last), part), lambda x: x["rank"] < F.col("quota"))

    taken = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), (epochs - 1).cast("long")), parts_of))
    empty = F.array().cast("array<struct<epoch:bigint,start:bigint,length:bigint,rank:bigint>>")
    placed = placed.withColumn("parts", F.when((F.col("size") > 0) & (epochs > 0), taken).otherwise(empty))
    placed = placed.withColumn("parts", F.transform("parts", lambda x: F.struct(x["epoch"].alias("epoch"), x["start"].alias("start"), x["length"].alias("length"), x["rank"].alias("rank"), shard(x["rank"]).alias("shard"))))
    return placed.select("uid", "doc_id", "skey", "size", "source_size", "target", "parts")


def mixed(taken: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: a row for each taken part, shuffled within its shard, a shard's slices in partitions of their own."""
    parts = taken.select("uid", "doc_id", "skey", F.explode("parts").alias("p")).select("uid", "doc_id", "skey", "p.*")
    parts = parts.withColumn("order", F.xxhash64(F.lit(seed), "skey", "rank"))
    return _by_shard(parts, taken, ["uid", "start"])


def _by_shard(rows: DataFrame, taken: DataFrame, ties: list[str], shard: str = "shard", order: str = "order") -> DataFrame:
    """``rows`` by shard and, within it, by ``order``, in as many slices of equal ranges as its words demand."""
    words = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    total, shards = taken.agg(F.sum(words), F.max(F.array_max(F.transform("parts", lambda x: x["shard"])))).first()
    slices = 1 << max(0, math.ceil(math.log2(max(1.0, (total or 0) / ((shards or 0) + 1) / SHARD_WORDS))))
    slice_ = F.floor((F.col(order).cast("double") / 2.0**64 + 0.5) * slices)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ((shards or 0) + 1) * slices)
    return rows.repartition(tasks, F.col(shard), slice_).sortWithinPartitions(shard, order, *ties)


def mixed_documents(docs: DataFrame, store: Store, text_col: str = "text", seed: int = 17, **names: str) -> DataFrame:
    """``docs`` with the words that the mix takes as text, a row for each row of which it takes any.

    A whole epoch's text is as it was, another's the words of its parts, in order; epochs stand one below another.
    Rows come by shard, that of a row's first part, and shuffled within it.
    """
    uid, size, parts_, words, shard, order = unused(docs, "_uid", "_size", "_parts", "_words", "_shard", "_order")
    rows = store.keep(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    sizes = store.keep(sizes_of(rows, text_col=text_col, uid=F.col(uid), **names), "sizes")
    taken = store.keep(taken_blocks(sizes, store, seed).filter(F.size("parts") > 0).select("uid", "skey", "size", "parts"), "parts")
    first = F.array_min(F.transform("parts", lambda p: F.struct(p["epoch"], p["start"], p["shard"], p["rank"])))
    parts = taken.select(F.col("uid").alias(uid), F.col("size").alias(size), F.col("parts").alias(parts_), first["shard"].alias(shard), F.xxhash64(F.lit(seed), "skey", first["rank"]).alias(order))
    total = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["length"])
    out = rows.join(parts, uid).withColumn(words, F.when(total(parts_) % F.col(size) != 0, F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"))))

    def epoch(e: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(parts_, lambda p: p["epoch"] == e), lambda p: F.struct(p["start"], p["length"])))
        some = F.array_join(F.flatten(F.transform(own, lambda p: F.slice(words, (p["start"] + 1).cast("int"), p["length"].cast("int")))), " ")
        return F.when(total(own) == F.col(size), F.col(text_col)).otherwise(some)

    text = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.array_max(F.transform(parts_, lambda p: p["epoch"]))), epoch), lambda t: t != ""), "\n")
    return _by_shard(out.withColumn(text_col, text), taken, [uid], shard, order).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each row of ``documents``, counted in the written shards."""
    store = Store(spark, "mix")
    sizes = store.keep(sizes_of(table(spark, sf_dir, "documents")), "sizes")
    taken = store.keep(taken_blocks(sizes, store), "taken")
    shards = store.keep(mixed(taken), "shards")
    found = shards.groupBy("uid").agg(F.sum("length").alias("taken"), F.count_distinct("shard").alias("n_shards"))
    store.only("taken", "shards")
    counted = taken.select("uid", "doc_id", "size", "source_size", "target").join(found, "uid", "left")
    return counted.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")))
