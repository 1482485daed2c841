"""Repeated passages: every byte covered by a ``WINDOW``-byte string that an earlier document has too is removed.

Earlier means a smaller doc_id; the first document keeps its copy. A byte string's earlier match is found by
longest-previous-factor arrays over suffixes sorted in many small shards, to a depth of ``WINDOW`` bytes:

* Shards. A window's key is the smallest hash of its ``GRAM``-byte strings, so equal windows have equal keys
  wherever they stand. A run of neighbouring windows with one key is a segment. Only segments whose key
  occurs in several documents are dealt out, with their bytes, by key.
* Suffix order. A shard's windows are sorted by their bytes, equal ones by document, with the common
  prefix length of neighbours in that order.
* Previous and next smaller positions. A window's candidates for an earlier match are the nearest one before
  and the nearest one after it, in suffix order, that stand in an earlier document; the longer of the
  common prefixes with either is the window's previous factor, capped at ``WINDOW``. A window whose factor
  reaches the cap is removed.

Later exact copies go first, without any of that, since an earlier document has all their windows; so a group
of thousands of copies costs no more than one text. Which keys occur in several documents is counted for all
texts; the answer comes back as a filter of 16 to 64 MB, as the number of keys demands (a
fuller filter lets more segments pass, never fewer). Before segments are dealt out, a task settles equal ones
among about ``FLUSH`` bytes of them by itself: all but the first document's are removed, and only that one's goes
on. Keys that come from ``HEAVY`` such parts or more have a filter of their own; their windows are dealt out
singly, by their own hash. So a passage that a third of all documents share sends each window once from each
part, and the windows at its edges, which differ by document, spread over all shards. The number of shards
grows with the bytes of the texts.

Defined results: null text is empty; texts shorter than ``WINDOW`` bytes keep all; rows with the same
doc_id are rows of their own and neither is earlier; a row without doc_id keeps all and is nobody's earlier
document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Store, bit_filter, flagged, lookup_join, table, utf8
from ._keys import by_shard, passes, shard_bits, shared_keys, tasks
from ._text import Buffer, chunks, equal_ranges, mix, range_hashes, ranges

WINDOW, GRAM, SHARD_BYTES, TASK_SHARDS, FLUSH, SORTED_AT_ONCE, HEAVY = 50, 20, 4_000_000, 4, 8_000_000, 200_000, 256
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _runs(texts: list[bytes]) -> Iterator[tuple[int, Buffer, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: its first text's number, its buffer, and each segment's text, key, first window and number of windows."""
    for first, last in chunks(texts):
        buf = Buffer(texts[first:last], lower=False)
        size = len(buf.raw)
        if size < WINDOW:
            continue
        at = np.arange(size - GRAM + 1)
        low = buf.hash(at, at + GRAM)
        span, width = WINDOW - GRAM + 1, 1
        while width * 2 <= span:  # minima over 2, 4, 8, ... neighbours
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        # windows that stay within a text
        count = np.maximum(0, buf.stop - buf.start - WINDOW + 1)
        text = np.repeat(np.arange(len(count)), count)
        where = np.repeat(buf.start - np.cumsum(count) + count, count) + np.arange(len(text))
        key = low[where]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))) if len(key) else np.empty(0, np.int64)
        # minima crowd at the low end; mixed again, they are even
        yield first, buf, text[new], mix(key[new]), where[new], np.diff(np.append(new, len(key)))


def _keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for k in range(0, len(batch), 512):
        for _, _, text, key, _, _ in _runs([x.encode("utf-8", "surrogatepass") for x in batch.column(0).slice(k, 512).to_pylist()]):
            yield _distinct(key, text)


def _distinct(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each key of a chunk once, without its lowest bit, which marks keys that several texts have."""
    order = np.lexsort((text, key))
    key, text = key[order] >> np.uint64(1), text[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    end = np.append(new[1:], len(key)) - 1
    return key[new] << np.uint64(1) | (text[new] != text[end]).astype(np.uint64)


def _parts(edges: np.ndarray, n: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges that end at an edge, of about ``size``."""
    a = 0
    while a < n:
        k = np.searchsorted(edges, a + size)
        b = int(edges[k]) if k < len(edges) else n
        yield a, b
        a = b


def previous_factors(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For rows of bytes and their documents: the length of the longest prefix that a row of an earlier document has too.

    Rows are sorted by bytes, equal rows by document. The nearest rows before and after, in that order,
    of earlier documents are the previous and next smaller positions; the common prefix with each is the
    least one between neighbours on the way. Steps that fail to find an earlier document skip on to where
    the row reached would look (all rows in each round at once).
    """
    n, width = windows.shape
    if not n:
        return np.empty(0, np.int64)
    order = np.lexsort((docs, *windows.T[::-1])) if width <= 8 else np.lexsort((docs, *_words(windows)[::-1]))
    w, d = windows[order], docs[order]
    same = w[1:] == w[:-1]
    lcp = np.where(same.all(1), width, same.argmin(1))
    best = np.zeros(n, np.int64)
    for side in (-1, 1):
        dd, ll = (d, lcp) if side < 0 else (d[::-1], lcp[::-1])
        to, least = np.arange(n) - 1, np.concatenate(([0], ll))
        todo = np.flatnonzero((to >= 0) & (least > 0))
        todo = todo[dd[to[todo]] >= dd[todo]]
        while len(todo):
            via = to[todo]
            # where the row reached has come so far; it may still be on its way, which is no harm
            least[todo] = np.minimum(least[todo], least[via])
            to[todo] = to[via]
            todo = todo[(to[todo] >= 0) & (least[todo] > 0)]
            todo = todo[dd[to[todo]] >= dd[todo]]
        found = np.where(to >= 0, least, 0)
        best = np.maximum(best, found if side < 0 else found[::-1])
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _words(windows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, whose order is that of the bytes."""
    full = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), np.uint8)
    full[:, : windows.shape[1]] = windows
    return [x.astype(np.uint64) for x in full.view(">u8").T]


def later_copies(data: np.ndarray, place: np.ndarray, count: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which segments have the same bytes as the first document's segment of the same hash and size; equal hashes are no proof."""
    order = np.lexsort((doc, count, hashes))
    new = np.flatnonzero(np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (count[order][1:] != count[order][:-1]))))
    first = np.empty(len(doc), np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(new, len(order))))
    later = doc > doc[first]
    later[later] = equal_ranges(data, place[later], place[first[later]], count[later] + WINDOW - 1)
    return later


def _removed(texts: DataFrame, keys: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """(uid, start, end): byte ranges of the texts (uid, doc_id, text) that are removed; they may overlap."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)
    names = ["shard", "uid", "doc", "start", "count", "data", "done"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            uid, doc, key, start, count, same = (np.concatenate([h[i] for h in held]) for i in range(6))
            data = np.concatenate([h[6] for h in held])
            place = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
            later = later_copies(data, place, count, doc, same)
            settled = np.stack([uid[later], start[later], start[later] + count[later] + WINDOW - 1], 1)
            first = np.flatnonzero(~later)
            order, shards, begin = by_shard(key[first], bits)
            cols: list[list] = [[] for _ in names]
            for n, (s, a, b) in enumerate(zip(shards, begin, begin[1:])):
                o = first[order[a:b]]
                done = settled[n :: len(shards)]
                for c, v in zip(cols, (s, uid[o].tobytes(), doc[o].tobytes(), start[o].astype(np.uint32).tobytes(), count[o].astype(np.uint32).tobytes(), data[ranges(place[o], count[o] + WINDOW - 1)].tobytes(), done.tobytes())):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                uids, docs = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for first, buf, text, key, where, count in _runs([x.encode("utf-8", "surrogatepass") for x in part.column(2).to_pylist()]):
                    hit = passes(shared.value[0], key)
                    text, key, where, count = text[hit], key[hit], where[hit], count[hit]
                    if not len(key):
                        continue
                    single = passes(shared.value[1], key)
                    if single.any():  # a window at a time
                        alone = ranges(where[single], count[single])
                        text = np.concatenate((text[~single], np.repeat(text[single], count[single])))
                        key = np.concatenate((key[~single], mix(buf.hash(alone, alone + WINDOW))))
                        where = np.concatenate((where[~single], alone))
                        count = np.concatenate((count[~single], np.ones(len(alone), np.int64)))
                    same = buf.hash(where, where + count + WINDOW - 1)
                    held.append((uids[first + text], docs[first + text], key, where - buf.start[text], count, same, buf.raw[ranges(where, count + WINDOW - 1)]))
                    size += len(held[-1][6])
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        get = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
        uid, doc, start, count, data = get("uid", np.int64), get("doc", np.int64), get("start", np.uint32).astype(np.int64), get("count", np.uint32).astype(np.int64), get("data", np.uint8)
        done = get("done", np.int64).reshape(-1, 3)
        place = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
        # windows as places in the shard's text; those whose hash only one document has are alone in the order
        owner, at = np.repeat(np.arange(len(count)), count), ranges(place, count)
        h = range_hashes(data, at, WINDOW)
        order = np.lexsort((doc[owner], h))
        hs, ds = h[order], doc[owner][order]
        new = np.concatenate(([True], hs[1:] != hs[:-1]))
        group = np.cumsum(new) - 1
        low = ds[np.flatnonzero(new)]
        high = ds[np.append(np.flatnonzero(new)[1:], len(ds)) - 1]
        some = order[(low != high)[group]]
        cut = np.zeros(len(at), bool)
        # equal windows have equal hashes and so stay together; a part's order has all that reaches the cap
        edges = np.flatnonzero(np.concatenate(([True], h[some][1:] != h[some][:-1]))) if len(some) else np.empty(0, np.int64)
        for a, b in _parts(edges, len(some), SORTED_AT_ONCE):
            own = some[a:b]
            cut[own] = previous_factors(data[at[own][:, None] + np.arange(WINDOW)], doc[owner[own]]) >= WINDOW
        gone = np.flatnonzero(cut)
        first = np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]]))) if len(gone) else np.empty(0, bool)
        a = gone[first]
        b = gone[np.append(np.flatnonzero(first)[1:], len(gone)) - 1] if len(gone) else a
        begin = start[owner[a]] + at[a] - place[owner[a]]
        found = np.stack([uid[owner[a]], begin, begin + (b - a) + WINDOW], 1)
        return pd.DataFrame(np.concatenate((done, found)), columns=["uid", "start", "end"])

    dealt = texts.select("uid", "doc_id", "text").mapInArrow(deal, "shard long, uid binary, doc binary, start binary, count binary, data binary, done binary")
    return dealt.repartition(tasks(texts, bits, TASK_SHARDS), "shard").groupBy("shard").applyInPandas(sort, "uid long, start long, end long")


def _cut(texts: DataFrame) -> DataFrame:
    """(uid, n_removed, n_spans, kept_sha256, spans) of texts (uid, text, ranges)."""
    names = ["uid", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part, rows = batch.slice(k, 256), []
                for uid, text, ranges in zip(*(c.to_pylist() for c in part.columns)):
                    data, spans = text.encode("utf-8", "surrogatepass"), []
                    for a, b in sorted((r["start"], r["end"]) for r in ranges):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    edges = [0, *(x for s in spans for x in s), len(data)]
                    kept = hashlib.sha256(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    rows.append((uid, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), spans))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))))], names)

    return texts.select("uid", "text", "ranges").mapInArrow(run, "uid long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>")


def repeated_passages(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row; spans are the removed byte ranges."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text")).withColumn("sha", F.sha2("text", 256))
    info = store.keep(text.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "info")
    total = info.count()
    may = (F.col("n_bytes") >= WINDOW) & F.col("doc_id").isNotNull()
    first = store.keep(info.filter(may).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.max("n_bytes").alias("bytes")), "first")
    size = first.agg(F.sum("bytes")).first()[0] or 0
    bits = shard_bits(docs, size, SHARD_BYTES)
    # a filter tells which texts have no copies; of the others the first is found by a join
    several = first.filter("rows > 1").select("sha", F.col("first").alias("doc_id"))
    tagged = flagged(text.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)), ["sha"], bit_filter(several, ["sha"]))
    single = tagged.filter(~F.col("flag")).select("doc_id", "text", "sha")
    firsts = tagged.filter("flag").select("doc_id", "text", "sha").join(first.select("sha", F.col("first").alias("doc_id")), ["sha", "doc_id"]).dropDuplicates(["sha", "doc_id"]).select("doc_id", "text", "sha")
    texts = store.keep(single.unionByName(firsts).withColumn("uid", F.monotonically_increasing_id()), "texts")
    # a key for about every 15 bytes
    keys = shared_keys(texts.select("text"), _keys_of, size / 15, bits, TASK_SHARDS, HEAVY, store, "keys")
    ranges = store.keep(_removed(texts, keys, bits).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    hit = flagged(texts.select("uid", "text"), ["uid"], bit_filter(ranges.select("uid"), ["uid"])).filter("flag").drop("flag")
    cuts = store.keep(_cut(hit.join(ranges, "uid")), "cuts")
    results = texts.select("uid", "sha", F.col("doc_id").alias("first")).join(cuts, "uid", "left").drop("uid", "first")
    results = store.keep(first.select("sha", "first", "rows").join(results, "sha"), "results")
    store.only("info", "results")
    mine = lookup_join(info.filter(may), results, ["sha"], "rows", total)
    later = F.col("doc_id") > F.col("first")
    nothing = F.array().cast("array<array<bigint>>")
    mine = mine.select(
        "doc_id",
        "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(later, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(later, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )
    rest = info.filter(~may).select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), nothing.alias("spans"))
    return mine.unionByName(rest)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text of ``documents`` without passages that an earlier one has."""
    return repeated_passages(table(spark, sf_dir, "documents"), Store(spark, "repeats")).drop("spans")
