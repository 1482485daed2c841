"""Near-duplicate documents: MinHash signatures, an inverted join over their coordinates, and exact confirmation.

A document's set holds its distinct runs of ``K`` words. Documents with equal sets (equal sums of two independent
64-bit hashes, one of them modulo a prime) are one class, and only a class's first document goes on. A signature
has ``M`` coordinates; each class is posted under every coordinate-value pair. Two sets with a similarity of 0.75
agree in 48 of 64 coordinates on average, and in fewer than ``MATCH`` = 26 with a probability of 1.3e-9; pairs below
that are left out. ``match=1`` posts whole signatures, and a pair at the threshold is lost with 0.25 ** 64 = 3e-39.

* Prefix: with the pairs of a class ordered by their frequency, rare first, two classes that agree in
  ``match`` coordinates share one of the first M - match + 1 pairs of either. Only these are posted, so the
  lists of a passage that many documents share are not read unless the passage is most of a document.
* Merging with skips: in each list every class is first paired with one hub only. The lists' pairs are merged, and
  collisions counted: those met in the lists, and, where they are too few, those over the rest of both signatures.
  Pairs at the threshold are confirmed on the texts' real runs of words. Lists whose classes are
  then in one component are skipped. In what remains, classes of different components are paired in lists
  of up to ``SMALL`` classes; longer lists get ``ROUNDS`` - 1 more hubs, and then the classes outside
  a list's largest component are compared with all classes of the list, block by block: collisions are
  counted coordinate by coordinate, and pairs above the threshold that join two components are confirmed.

So no list is turned into all its pairs, no pair above the match threshold is lost, and the links of a hot list are
found in many tasks. Components come from label propagation with pointer jumping over written tables.

Defined results: null, empty or blank text has an empty set and is linked with nothing; fewer than K words
are one run; a row without doc_id is a component of its own without id, and kept; rows with equal
doc_id are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Store, bit_filter, flagged, lookup_join, table, unused, utf8
from ._keys import passes, shard_bits, shared_keys
from ._text import Buffer, chunks, equal_ranges, mix, prime_hashes, shingles

K, M, MATCH, SMALL, ROUNDS, BLOCK, BLOCK_BYTES, SHARD_BYTES, TASK_SHARDS = 5, 64, 26, 64, 3, 512, 8_000_000, 16_000_000, 2
SIMILAR = (3, 4)  # 0.75
_RNG = np.random.default_rng(75)
MULTIPLY = _RNG.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
XOR = _RNG.integers(0, 1 << 63, M, dtype=np.uint64)


def _runs(texts: list[bytes]) -> tuple[Buffer, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, words' starts and ends, two hashes of each run of words, and each text's first run (one more at the end)."""
    buf = Buffer(texts)
    start, end, at = buf.words()
    prime = mix(prime_hashes(buf.bytes, start, end))
    hashes, begin = shingles(mix(buf.hash(start, end) ^ prime), at, K)
    return buf, start, end, hashes, shingles(prime, at, K)[0], begin


class Sets:
    """The sets of many texts, by their first runs of each kind, for comparing pairs on their real words."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buf, self.start, self.end, hashes, _, begin = _runs(texts)
        self.words = np.searchsorted(self.start, np.append(self.buf.start, len(self.buf.bytes)))
        self.own = [np.unique(hashes[a:b], return_index=True) for a, b in zip(begin, begin[1:])]

    def similar(self, x: int, y: int) -> bool:
        """Whether two texts' sets are similar; runs count as shared if their words are the same bytes."""
        (a, at_a), (b, at_b) = self.own[x], self.own[y]
        shared, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        enough = lambda both: both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]
        return bool(len(shared)) and enough(len(shared)) and enough(int(self._same(x, at_a[i], y, at_b[j]).sum()))

    def _same(self, x: int, i: np.ndarray, y: int, j: np.ndarray) -> np.ndarray:
        """Whether the runs from words i of x and j of y are the same."""
        n_x, n_y = (min(K, self.words[t + 1] - self.words[t]) for t in (x, y))
        if n_x != n_y:
            return np.zeros(len(i), bool)
        out = np.ones(len(i), bool)
        for k in range(n_x):
            u, v = self.words[x] + i + k, self.words[y] + j + k
            size = self.end[u] - self.start[u]
            out &= size == self.end[v] - self.start[v]
            out[out] = equal_ranges(self.buf.bytes, self.start[u][out], self.start[v][out], size[out])
        return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n, a, b, sig): a hash of the text, the set's size, two hashes of the whole set, and its signature (null if it is empty)."""
    names = ["doc_id", "h", "n", "a", "b", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            n, a, b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            sig = np.zeros((len(texts), M), np.uint32)
            for first, last in chunks(texts):
                _, _, _, h, other, begin = _runs(texts[first:last])
                for i in range(len(begin) - 1):
                    own, at = np.unique(h[begin[i] : begin[i + 1]], return_index=True)
                    n[first + i], a[first + i], b[first + i] = len(own), own.sum(dtype=np.uint64), other[begin[i] + at].sum(dtype=np.uint64)
                full = np.flatnonzero(np.diff(begin))
                if len(full):
                    for j in range(M):
                        sig[first + full, j] = np.minimum.reduceat((h ^ XOR[j]) * MULTIPLY[j], begin[full]) >> np.uint64(32)
            some = n > 0
            offsets = pa.array(np.concatenate(([0], np.cumsum(some) * M)).astype(np.int32), mask=np.append(~some, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(sig[some].view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names)

    text = utf8(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, h long, n long, a long, b long, sig array<int>")


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """(uid, label) for every end of an edge (x, y): the smallest uid of its component."""
    both = store.keep(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}-edges")
    labels = store.keep(both.groupBy(F.col("x").alias("uid")).agg(F.min("y").alias("m")).select("uid", F.least("uid", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("uid").alias("y"), "label"), "y").groupBy(F.col("x").alias("uid")).agg(F.min("label").alias("m"))
        hooked = store.keep(labels.join(near, "uid").select("uid", F.col("label").alias("old"), F.least("label", "m").alias("label")), f"{name}-{step}a")
        jump = hooked.select(F.col("uid").alias("label"), F.col("label").alias("far"))
        new = store.keep(hooked.join(jump, "label").select("uid", "old", F.col("far").alias("label")), f"{name}-{step}")
        if not new.filter("label <> old").limit(1).count():
            return new.select("uid", "label")
        labels = new.select("uid", "label")


def _long_enough(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    """Each signature's coordinate-value pairs, a row for a class; the last column of the batch has the signatures."""
    value = batch.column(len(batch.columns) - 1).flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, M)
    return value.astype(np.uint64) | (np.arange(M, dtype=np.uint64) << np.uint64(32))


def _key(token: np.ndarray) -> np.ndarray:
    return mix(token) & ~np.uint64(1)


def _prefix(classes: DataFrame, total: int, store: Store, match: int) -> DataFrame:
    """(token, uid, n): the postings of each class under the rarest of its coordinate-value pairs that others have too."""
    rows = classes.select("uid", "n", "sig")
    shards = shard_bits(rows, total * M * 8, SHARD_BYTES)
    bits, _ = shared_keys(rows, lambda batch: iter([_key(_tokens(batch)).ravel()]), total * M, shards, TASK_SHARDS, 1 << 62, store, "shared")
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = _tokens(batch)
            row, col = np.nonzero(passes(shared.value, _key(token).ravel()).reshape(token.shape))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(token[row, col].view(np.int64))], ["uid", "n", "token"])

    # the filter lets a few pairs pass that one class has alone; the count leaves them out
    tokens = store.keep(rows.mapInArrow(pick, "uid long, n long, token long"), "tokens")
    freq = tokens.groupBy("token").agg(F.count("*").alias("freq")).filter("freq > 1")
    found = lookup_join(tokens, freq, ["token"], "freq", max(1, tokens.count()))
    # pairs that no other class has come first in the order and count towards the prefix, but need no list
    mine = found.groupBy("uid", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("t"))
    mine = mine.withColumn("t", F.slice("t", F.lit(1), F.greatest(F.lit(0), F.size("t") - (match - 1))))
    return mine.select("uid", "n", F.explode("t.token").alias("token"))


def text_table(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, text): the texts of the classes ``wanted`` (uid, doc_id, h); a filter of fixed size drops most others before the join."""
    text = utf8(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    some = flagged(texts, ["doc_id", "h"], bit_filter(wanted, ["doc_id", "h"])).filter("flag").drop("flag")
    return some.join(wanted.select("doc_id", "h", "uid"), ["doc_id", "h"]).select("uid", "text").dropDuplicates(["uid"])


def _confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, store: Store, name: str, match: int) -> DataFrame:
    """Those of the collisions (x, y), a row for each list they met in, that reach ``match`` and are similar on their texts."""
    sig = lambda c: classes.select(F.col("uid").alias(c), F.col("sig").alias(f"sig_{c}"))
    met = pairs.groupBy("x", "y").agg(F.count("*").alias("met"))
    hits = F.aggregate(F.zip_with("sig_x", "sig_y", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    enough = (F.col("met") >= match) | (hits >= match)
    likely = store.keep(met.join(sig("x"), "x").join(sig("y"), "y").filter(enough).select("x", "y"), f"{name}-likely")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[t.encode("utf-8", "surrogatepass") for t in batch.column(c).to_pylist()] for c in (2, 3)]
            good = np.zeros(len(batch), bool)
            for first, last in chunks([a + b for a, b in zip(*both)]):
                own: dict[bytes, int] = {}
                at = [[own.setdefault(t, len(own)) for t in side[first:last]] for side in both]
                sets = Sets([*own])
                good[first:last] = [sets.similar(i, j) for i, j in zip(*at)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["x", "y"])

    whole = lambda c: texts.select(F.col("uid").alias(c), F.col("text").alias(f"text_{c}"))
    found = likely.join(whole("x"), "x").join(whole("y"), "y").select("x", "y", "text_x", "text_y")
    return store.keep(found.mapInArrow(compare, "x long, y long"), f"{name}-links")


def _hub_pairs(lists: DataFrame, total: int, turn: int) -> DataFrame:
    """Each class of a list with the list's hub; ``turn`` picks the hubs. Needs (token, uid, n, label, size)."""
    lists = lists.select("token", "uid", "n", "label", "size")
    hub = lists.groupBy("token", "size").agg(F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("h") if turn else F.lit(0).alias("h"), "uid", "n", "label")).alias("hub"))
    rows = lookup_join(lists, hub, ["token"], "size", total)
    rows = rows.filter((F.col("uid") != F.col("hub.uid")) & (F.col("label") != F.col("hub.label")) & _long_enough(F.col("n"), F.col("hub.n")))
    return rows.select(F.least("uid", "hub.uid").alias("x"), F.greatest("uid", "hub.uid").alias("y"))


def _small_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of classes of different components in lists of at most SMALL classes."""
    rows = lists.groupBy("token").agg(F.collect_list(F.struct("uid", "n", "label")).alias("r"))
    later = lambda a, i: F.filter(F.slice("r", i + 2, F.greatest(F.size("r") - i - 1, F.lit(0))), lambda b: (a["label"] != b["label"]) & _long_enough(a["n"], b["n"]))
    pairs = F.flatten(F.transform("r", lambda a, i: F.transform(later(a, i), lambda b: F.struct(F.least(a["uid"], b["uid"]).alias("x"), F.greatest(a["uid"], b["uid"]).alias("y")))))
    return rows.select(F.explode(pairs).alias("p")).select("p.x", "p.y")


def _block_links(lists: DataFrame, total: int, classes: DataFrame, texts: DataFrame, store: Store, match: int) -> DataFrame:
    """Links that classes outside a long list's largest component have with any class of the list.

    The classes of all lists that are led by one component form its arena. The ones outside are compared
    with all, in blocks of bounded size; a block gives a link only where it joins two of its components.
    """
    lists = lists.select("token", "uid", "n", "label", "size")
    by = lists.groupBy("token", "size", "label").agg(F.count("*").alias("c"))
    lead = by.groupBy("token", "size").agg(F.max(F.struct("c", "label"))["label"].alias("arena"))
    rows = lookup_join(lists, lead, ["token"], "size", total).groupBy("arena", "uid").agg(F.max((F.col("label") != F.col("arena")).cast("int")).alias("out"), F.min("label").alias("label"), F.min("n").alias("n"))
    rows = store.keep(rows, "arena-rows")
    part = lambda c, w: F.greatest(F.ceil(F.sum(c) / BLOCK), F.ceil(F.sum(c * w) * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    size = rows.groupBy("arena").agg(part(F.col("out"), F.col("n")).alias("q_out"), part(F.lit(1), F.col("n")).alias("q_all"), F.count("*").alias("size"))
    size = store.keep(size, "arenas")
    blocks = size.agg(F.sum(F.col("q_out").cast("long") * F.col("q_all"))).first()[0] or 0
    rows = lookup_join(rows, size, ["arena"], "size", rows.count())
    place = lambda q, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), q).cast("int")
    to = lambda q: F.sequence(F.lit(0), q - 1)
    outside = rows.filter("out = 1").withColumn("i", place(F.col("q_out"), 1)).withColumn("j", F.explode(to(F.col("q_all")))).withColumn("role", F.lit(0))
    inside = rows.withColumn("j", place(F.col("q_all"), 2)).withColumn("i", F.explode(to(F.col("q_out")))).withColumn("role", F.lit(1))
    names = ["arena", "i", "j", "uid", "label", "role", "n"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = np.flatnonzero(pdf.role == 0), np.flatnonzero(pdf.role == 1)
        if not len(left) or not len(right):
            return pd.DataFrame({"x": [], "y": []}, dtype="int64")
        uid, label, n = (pdf[c].to_numpy() for c in ("uid", "label", "n"))
        sig, parent, sets = np.stack(pdf.sig.to_numpy()), {}, Sets([t.encode("utf-8", "surrogatepass") for t in pdf.text])

        def top(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = v = parent.get(p, p)
            return v

        out = []
        for k in left:
            hits = (sig[right] == sig[k]).sum(1)
            fit = np.minimum(n[right], n[k]) * SIMILAR[1] >= np.maximum(n[right], n[k]) * SIMILAR[0]
            for i in right[(hits >= match) & fit & (label[right] != label[k])]:
                a, b = top(label[k]), top(label[i])
                if a != b and sets.similar(k, i):
                    parent[a] = b
                    out.append((uid[k], uid[i]))
        return pd.DataFrame(out, columns=["x", "y"]).astype("int64")

    work = outside.select(names).unionByName(inside.select(names)).join(classes.select("uid", "sig"), "uid").join(texts, "uid")
    # dealt by an explicit number of tasks: a block has few bytes and much work
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    return store.keep(work.repartition(tasks, "arena", "i", "j").groupBy("arena", "i", "j").applyInPandas(compare, "x long, y long"), "arena-links")


def near_duplicates(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH) -> DataFrame:
    """(uid, doc_id, h, n_shingles, component_id, kept) for each row, h being xxhash64 of the text; see the module for the method."""
    if not 1 <= match <= M:
        raise ValueError(f"match must be from 1 to {M}")
    signed = signatures(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    signed = store.keep(signed, "signatures")
    part = signed.filter("n > 0 and doc_id is not null")
    one = part.groupBy("n", "a", "b").agg(F.min(F.struct("uid", "doc_id", "h", "sig")).alias("m"), F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classes = store.keep(one.select("n", "a", "b", "m.uid", "m.doc_id", "m.h", "m.sig", "least", "rows"), "classes")
    n_classes = classes.count()
    lists = store.keep(_prefix(classes, n_classes, store, match), "prefix")
    alone = lists.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    lists = store.keep(lookup_join(lists, alone, ["token"], "size", max(1, lists.count())), "lists")
    total = lists.count()
    labels = None
    if total:
        wanted = classes.join(lists.select("uid").distinct(), "uid", "left_semi")
        texts = store.keep(text_table(docs, wanted, id_col, text_col), "texts")
        links, left = None, lists
        for turn in range(ROUNDS):
            if labels is None:
                now = lists.withColumn("label", F.col("uid"))
            else:  # components only grow, so a list that is in one stays so
                left = _open_lists(left, labels, total, store, f"open{turn}")
                now = left.filter(F.col("size") > SMALL)
                if not now.limit(1).count():
                    break
            new = _confirm(_hub_pairs(now, total, turn), classes, texts, store, f"hub{turn}", match)
            links = new if links is None else links.unionByName(new)
            labels = components(links, store, f"labels{turn}")
        rest = _open_lists(left, labels, total, store, "open")
        links = links.unionByName(_confirm(_small_pairs(rest.filter(F.col("size") <= SMALL)), classes, texts, store, "small", match))
        long = rest.filter(F.col("size") > SMALL)
        if long.limit(1).count():
            links = links.unionByName(_block_links(long, total, classes, texts, store, match))
        labels = components(links, store, "labels")
    named = classes.select("n", "a", "b", "uid", "least", "rows")
    named = named.withColumn("label", F.col("uid")) if labels is None else named.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    named = store.keep(named, "named")
    # only components of several classes need their first document looked up
    first = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = lookup_join(named.select("n", "a", "b", "rows", "label"), first, ["label"], "size", n_classes).select("n", "a", "b", "rows", "component_id")
    named = store.keep(named, "components")
    store.only("signatures", "components")
    out = lookup_join(part.select("uid", "doc_id", "h", "n", "a", "b"), named, ["n", "a", "b"], "rows", signed.count()).select("uid", "doc_id", "h", "n", "component_id")
    out = out.unionByName(signed.filter("n = 0 or doc_id is null").select("uid", "doc_id", "h", "n", F.col("doc_id").alias("component_id")))
    return out.select("uid", "doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH) -> DataFrame:
    """The rows of ``docs`` that are the first of their components, each once, with all columns.

    A filter over what is to go lets most rows pass without a shuffle.
    """
    marks = store.keep(near_duplicates(docs, store, id_col, text_col, match).select("doc_id", "h", "kept"), "marks")
    counted = marks.filter("doc_id is not null").groupBy("doc_id", "h").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).filter("not kept or rows > 1")
    open_ = store.keep(counted, "left-open")
    store.only("left-open")
    id_, h, flag = unused(docs, "_id", "_h", "_flag")
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), h: F.xxhash64(utf8(F.col(text_col)))})
    sifted = flagged(keyed, [id_, h], bit_filter(open_, ["doc_id", "h"]), flag)
    named = F.col(id_).isNotNull()
    passed, held = sifted.filter(~F.col(flag) | ~named), sifted.filter(F.col(flag) & named)
    keys = lambda kept: open_.filter(F.col("kept") == kept).select(F.col("doc_id").alias(id_), F.col("h").alias(h))
    held = held.join(keys(False), [id_, h], "left_anti")
    single, several = held.join(keys(True), [id_, h], "left_anti"), held.join(keys(True), [id_, h], "left_semi").dropDuplicates([id_, h])
    return passed.unionByName(single).unionByName(several).select(*docs.columns)


def _open_lists(lists: DataFrame, labels: DataFrame, total: int, store: Store, name: str) -> DataFrame:
    """(token, uid, n, label, size) of the lists whose classes are in several components."""
    rows = store.keep(lists.select("token", "uid", "n", "size").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid")), f"{name}-rows")
    several = rows.groupBy("token", "size").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token", "size")
    return store.keep(lookup_join(rows, several, ["token"], "size", total), name)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with its component of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), Store(spark, "near")).drop("uid", "h")
