"""The library's queries over the test tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pairs as P
from ..functions import text as X
from ..operators.dictionary import RankedDictionary, edit_lookup, find_all_matches, within_edits
from ..operators.fuzzy_join import fuzzy_self_join, gram_table, pair_scores, shared_gram_similarity
from ..operators.lookup import GramIndex
from ..operators.patterns import PatternSet
from ..operators.word_set import WordSet
from ..sources.text import read_characters, read_first_fields, read_words, replace_files, write_words
from ..streaming.lookup import GrowingIndex, lookup_stream
from . import sql as S
from .settle import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TOKEN = r"[\p{L}\p{M}\p{N}\p{Co}]+"
#: The patterns that the find and replace queries look for.
KEYS = ("the", "there", "he", "her", "here", "in", "ing", "tion", "ation", "en", "ent", "und", "que", "de", "des")
REPLACED = {k: f"<{k.upper()}>" for k in KEYS}
CHANGED = "substring(p_name, 1, 2) || substring(p_name, 4)"  # names without their third character
NAMES, TYPOS = "SELECT DISTINCT p_name AS word FROM part WHERE p_name IS NOT NULL", f"SELECT DISTINCT {CHANGED} AS query FROM part WHERE p_name IS NOT NULL"
BENCH_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM benchmark"


def _round(value: Column | str) -> Column:
    """To 6 places, by way of 9: sums whose terms come in another order agree in these, so that ties round alike."""
    return F.round(F.round(value, 9), 6)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").filter("p_name is not null").select(F.col("p_name").alias("word")).distinct()


def _typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").filter("p_name is not null").select(F.expr(CHANGED).alias("query")).distinct()


def _bench_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()


def _doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("word"))


DOC_WORDS = f"SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM documents"

# earth-mover cost and pairs of words


@query(
    "emd_1d_pairs",
    f"""WITH o AS (SELECT l_orderkey, list_sort(list(l_discount)) AS x, list_sort(list(l_tax)) AS y, list_sort(list(l_discount) FILTER (l_quantity > 25)) AS z FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round({S.emd("x", "y")}, 6) AS equal_sizes, round({S.emd("x", "coalesce(z, []::DOUBLE[])")}, 6) AS unequal_sizes FROM o""",
)
def emd_1d_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("x"), F.collect_list("l_tax").alias("y"), F.collect_list(F.when(F.col("l_quantity") > 25, F.col("l_discount"))).alias("z"))
    return o.select("l_orderkey", F.round(C.emd_1d(F.col("x"), F.col("y")), 6).alias("equal_sizes"), F.round(C.emd_1d(F.col("x"), F.col("z")), 6).alias("unequal_sizes"))


for _n in (2, 3):

    @query(f"gram_profile_n{_n}", f"SELECT word, gram, len(pos) AS n_positions, round(list_sum(pos), 6) AS sum_positions FROM ({S.gram_rows(f'({NAMES})', _n)})")
    def gram_profile(spark: SparkSession, sf_dir: str, n: int = _n) -> DataFrame:
        g = gram_table(_names(spark, sf_dir), "word", n)
        return g.select("word", "gram", F.size("pos").cast("long").alias("n_positions"), F.round(F.aggregate("pos", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_positions"))


_TOTAL = "(len(a.word) + len(b.word) + 2)"


@query(
    "pair_scores",
    f"""WITH a AS ({NAMES}), b AS (SELECT DISTINCT lower(p_type) AS word FROM part), s AS ({S.pair_similarity("a", "b")})
    SELECT a.word AS name, b.word AS type, round(coalesce(sim, 0), 6) AS similarity, round(round({_TOTAL} - coalesce(sim, 0), 9), 6) AS distance,
      round(round(coalesce(sim, 0) / {_TOTAL}, 9), 6) AS similarity_norm, round(round(1 - coalesce(sim, 0) / {_TOTAL}, 9), 6) AS distance_norm
    FROM (SELECT DISTINCT p_name, lower(p_type) AS t FROM part) p JOIN a ON a.word = p_name JOIN b ON b.word = t LEFT JOIN s ON s.l = a.word AND s.r = b.word""",
)
def pair_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lower("p_type").alias("type")).distinct()
    scored = pair_scores(pairs, "name", "type")
    return scored.select("name", "type", *(_round(c).alias(c) for c in ("similarity", "distance", "similarity_norm", "distance_norm")))


for _n in (3, 4):
    _total = f"(len(a.word) + len(b.word) + {6 - 2 * _n})"

    @query(
        f"pair_scores_n{_n}",
        f"""WITH a AS ({NAMES}), b AS (SELECT DISTINCT lower(p_type) AS word FROM part), s AS ({S.pair_similarity("a", "b", _n)})
        SELECT a.word AS name, b.word AS type, round(round({_total} - coalesce(sim, 0), 9), 6) AS distance, round(round(coalesce(sim, 0) / {_total}, 9), 6) AS similarity_norm
        FROM (SELECT DISTINCT p_name, lower(p_type) AS t FROM part) p JOIN a ON a.word = p_name JOIN b ON b.word = t LEFT JOIN s ON s.l = a.word AND s.r = b.word""",
    )
    def pair_scores_longer(spark: SparkSession, sf_dir: str, n: int = _n) -> DataFrame:
        pairs = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lower("p_type").alias("type")).distinct()
        return pair_scores(pairs, "name", "type", n).select("name", "type", _round("distance").alias("distance"), _round("similarity_norm").alias("similarity_norm"))


@query("shared_gram_similarity", f"WITH a AS ({NAMES}) SELECT l AS \"left\", r AS \"right\", round(sim, 6) AS similarity FROM ({S.pair_similarity('a', 'a')})")
def shared_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    return shared_gram_similarity(names, names).select("left", "right", _round("similarity").alias("similarity"))


def _self_join_sql(source: str, least: float) -> str:
    return f"""WITH a AS ({source}) SELECT l AS "left", r AS "right", round(round(sim / (len(l) + len(r) + 2), 9), 6) AS similarity
      FROM ({S.pair_similarity("a", "a")}) WHERE l < r AND sim / (len(l) + len(r) + 2) >= {least} - 1e-9"""


@query("fuzzy_self_join", _self_join_sql(NAMES, 0.5))
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_self_join(_names(spark, sf_dir), 0.5).withColumn("similarity", _round("similarity"))


@query("fuzzy_self_join_words", _self_join_sql(BENCH_WORDS, 0.7))
def fuzzy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_self_join(_bench_words(spark, sf_dir), 0.7).withColumn("similarity", _round("similarity"))


_POWERS = "pow((pow(l_discount, {d}) + pow(l_tax, {d})) / 2, 1.0 / {d})"


@query("power_mean", f"SELECT l_orderkey, l_linenumber, round({_POWERS.format(d=1)}, 6) AS mean_1, round({_POWERS.format(d=2)}, 6) AS mean_2 FROM lineitem")
def power_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array("l_discount", "l_tax")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.power_mean(v, 1), 6).alias("mean_1"), F.round(C.power_mean(v, 2), 6).alias("mean_2"))


# dictionary lookups


def _lookup(name: str, sql: str, n: tuple[int, ...] = (2, 4), filter_n: int = 3, **options: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = GramIndex.build(_names(spark, sf_dir), n=n, filter_n=filter_n)
        out = index.lookup(_typos(spark, sf_dir), **options)
        return out.select("query", "rank", "word", _round("score").alias("score"), _round("sim2").alias("sim2"))

    query(name, sql)(run)


_lookup("wordlist_lookup_norm", S.lookup(NAMES, TYPOS, (2, 4), 5), normalize=True)
_lookup("wordlist_lookup_pruned", S.lookup(NAMES, TYPOS, (2, 4), 5), normalize=True, prune=True)
_lookup("wordlist_lookup_raw", S.lookup(NAMES, TYPOS, (2, 4), 5, normalize=False))
_lookup("wordlist_lookup_dim2", S.lookup(NAMES, TYPOS, (2, 4), 5, dim=2), normalize=True, dim=2)
_lookup("wordlist_lookup_nofilter", S.lookup(NAMES, TYPOS, (2, 4), 5, filter_n=0), filter_n=0, normalize=True)
_lookup("wordlist_lookup_n1234", S.lookup(NAMES, TYPOS, (1, 2, 3, 4), 3), n=(1, 2, 3, 4), normalize=True, top_k=3)
_lookup("wordlist_v5_2k", S.lookup(NAMES, TYPOS, (2, 4), 5, mode="v5"), normalize=True, scoring="v5")
_lookup("wordlist_v5b", S.lookup(NAMES, TYPOS, (2, 4), 5, mode="v5b"), normalize=True, scoring="v5b")
_lookup("wordlist_v3", S.lookup(NAMES, TYPOS, (2, 4), 5, mode="v3"), scoring="v3")


@query("wordlist_v5_distance", f"SELECT query, rank, word, round(1 - score, 6) AS distance FROM ({S.lookup(NAMES, TYPOS, (2, 4), 5, mode='v5')})")
def v5_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = GramIndex.build(_names(spark, sf_dir)).lookup(_typos(spark, sf_dir), normalize=True, scoring="v5", invert=False)
    return out.select("query", "rank", "word", F.round(1 - F.round(1 - F.col("score"), 6), 6).alias("distance"))


# the words have no other letter whose case folding isn't its lower case
_FOLD = "replace(lower({}), 'ß', 'ss')".format


@query("wordlist_words", S.lookup(f"SELECT DISTINCT {_FOLD('word')} AS word FROM ({BENCH_WORDS})", f"SELECT DISTINCT {_FOLD('substring(word, 1, len(word) - 1)')} AS query FROM ({BENCH_WORDS}) WHERE len(word) > 5", (2, 4), 3))
def lookup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _bench_words(spark, sf_dir)
    typos = words.filter(F.length("word") > 5).select(X.casefold(F.expr("substring(word, 1, length(word) - 1)")).alias("query")).distinct()
    out = GramIndex.build(words).lookup(typos, top_k=3, normalize=True)
    return out.select("query", "rank", "word", _round("score").alias("score"), _round("sim2").alias("sim2"))


#: The misspellings that lookups are commonly timed with.
MISSPELLINGS = ("bananananaanananananana", "bananana", "supercallousedfragilemisticexepialidocus", "asalamalaikum", "beewilldermant", "blackbary", "kartweel", "chomosrome", "chrisanthumem", "instalatiomn")


@query("wordlist_documents", S.lookup(f"SELECT DISTINCT {_FOLD('word')} AS word FROM ({DOC_WORDS})", f"SELECT unnest({[*MISSPELLINGS]}) AS query", (2, 4), 5))
def lookup_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspellings among all words of ``documents``."""
    asked = spark.createDataFrame([(x,) for x in MISSPELLINGS], "query string")
    out = GramIndex.build(_doc_words(spark, sf_dir)).lookup(asked, top_k=5, normalize=True)
    return out.select("query", "rank", "word", _round("score").alias("score"), _round("sim2").alias("sim2"))


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/queries/{uuid.uuid4().hex}"


@query("wordlist_saved", S.lookup(NAMES, TYPOS, (2, 4), 5))
def lookup_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _own_folder(spark)
    GramIndex.build(_names(spark, sf_dir)).save(path)
    out = GramIndex.load(spark, path).lookup(_typos(spark, sf_dir), normalize=True)
    return out.select("query", "rank", "word", _round("score").alias("score"), _round("sim2").alias("sim2"))


def _stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = _own_folder(spark)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(writer) -> None:
    """Runs a stream over all that is there."""
    run = writer.option("checkpointLocation", _own_folder(writer._spark)).trigger(availableNow=True).start()
    run.awaitTermination()


@query("streaming_lookup", S.lookup(NAMES, TYPOS, (2, 4), 5))
def streaming_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _own_folder(spark)
    write = lambda found, number: found.write.mode("overwrite").parquet(f"{path}/{number}")
    _drained(lookup_stream(_stream(spark, _typos(spark, sf_dir)), GramIndex.build(_names(spark, sf_dir)), write, normalize=True))
    out = spark.read.parquet(f"{path}/*")
    return out.select("query", "rank", "word", _round("score").alias("score"), _round("sim2").alias("sim2"))


@query("streaming_growth", "SELECT DISTINCT p_name AS word FROM part")
def streaming_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    growing = GrowingIndex(GramIndex.build(_names(spark, sf_dir).filter("word < 'm'")), compact_every=1)
    _drained(growing.add_stream(_stream(spark, _names(spark, sf_dir))))
    return growing.index.vocabulary


@query("source_words", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t-\\r]+')) AS word FROM benchmark) GROUP BY word")
def source_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines, and read again as words."""
    path = _own_folder(spark)
    write_words(_t(spark, sf_dir, "benchmark"), path, "text")
    return read_words(spark, path).groupBy("word").agg(F.count("*").alias("n"))


@query("source_first_fields", "SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1")
def source_first_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _own_folder(spark)
    write_words(_t(spark, sf_dir, "part").select(F.concat_ws(",", "p_name", "p_type", "p_brand").alias("word")), path)
    return read_first_fields(spark, path).groupBy("word").agg(F.count("*").alias("n"))


@query("source_characters", "SELECT p_name AS value, (i - 1)::INT AS i, substring(p_name, i::INT, 1) AS char FROM (SELECT DISTINCT p_name FROM part), unnest(range(1, len(p_name) + 1)) t(i)")
def source_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _own_folder(spark)
    write_words(_names(spark, sf_dir), path)
    return read_characters(spark, path)


@query("wordlist_vocabulary", "SELECT DISTINCT lower(p_type) AS word FROM part")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GramIndex.build(_t(spark, sf_dir, "part"), word="p_type").vocabulary


@query("wordlist_contains", "SELECT p_partkey, p_name, lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size > 25) AS found FROM part")
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return GramIndex.build(part.filter("p_size > 25"), word="p_name").contains(part.select("p_partkey", "p_name"), "p_name")


@query("wordlist_add", S.lookup(NAMES, TYPOS, (2, 4), 1).replace("SELECT row_number() OVER (ORDER BY word) - 1 AS word_id, word FROM", "SELECT row_number() OVER (ORDER BY word NOT IN (SELECT p_name FROM part WHERE p_size > 25), word) - 1 AS word_id, word FROM"))
def add_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    out = GramIndex.build(part.filter("p_size > 25"), word="p_name").add(part, "p_name").lookup(_typos(spark, sf_dir), top_k=1, normalize=True)
    return out.select("query", "rank", "word", _round("score").alias("score"), _round("sim2").alias("sim2"))


# word sets


def _similar(name: str, n: tuple[int, ...], filter_n: int, k: int = 5, least: float | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = WordSet(_names(spark, sf_dir), ngram_sizes=n).find_similar(_typos(spark, sf_dir), k=k, min_similarity=least)
        return out.select("query", "rank", "word", _round("similarity").alias("similarity"))

    query(name, S.word_set(NAMES, TYPOS, n, filter_n, k, least or 0.0))(run)


_similar("wordset_find_similar", (2, 3, 4), 3)
_similar("wordset_n12", (1, 2), 1, 3)
_similar("wordset_min_similarity", (2, 3, 4), 3, least=0.5)


@query("wordset_suggest", f"SELECT query, rank, word FROM ({S.word_set(NAMES, TYPOS, (2, 3, 4), 3, 2)})")
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WordSet(_names(spark, sf_dir)).suggest(_typos(spark, sf_dir), k=2)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = _t(spark, sf_dir, "conversations").select(F.explode(X.words(F.col("text"))).alias("word"))
    return _bench_words(spark, sf_dir), turns


def _members(source: str) -> str:
    """Normal forms with the least spelling of each."""
    return f"SELECT nfc_normalize({_FOLD('word')}) AS k, min(word) AS word FROM ({source}) GROUP BY 1"


_SMALL, _LARGE = _members(BENCH_WORDS), _members(f"SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM conversations")
_SETS = f"WITH s AS ({_SMALL}), l AS ({_LARGE})"
_ONLY_S, _ONLY_L, _BOTH = "SELECT word FROM s ANTI JOIN l USING (k)", "SELECT word FROM l ANTI JOIN s USING (k)", "SELECT word FROM s SEMI JOIN l USING (k)"
for _name, _sql in (("union", f"SELECT word FROM s UNION ALL {_ONLY_L}"), ("intersection", _BOTH), ("difference", _ONLY_S), ("symmetric_difference", f"{_ONLY_S} UNION ALL {_ONLY_L}")):

    @query(f"wordset_{_name}", f"{_SETS} {_sql}")
    def set_op(spark: SparkSession, sf_dir: str, op: str = _name) -> DataFrame:
        small, large = _halves(spark, sf_dir)
        return getattr(WordSet(small), op)(large).words()


@query("wordset_discard", f"SELECT word FROM ({_SMALL}) WHERE len(k) > 5")
def set_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _bench_words(spark, sf_dir)
    return WordSet(words).discard(words.select(X.normalize_nfc(X.casefold(F.col("word"))).alias("word")).filter(F.length("word") <= 5)).words()


@query("wordset_remove", f"SELECT word FROM ({_SMALL}) WHERE NOT starts_with(k, 'th')")
def set_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _bench_words(spark, sf_dir)
    return WordSet(words).remove(words.filter(F.lower("word").startswith("th"))).words()


@query("wordset_pop", f"WITH s AS ({_SMALL}) SELECT word, word = (SELECT min(word) FROM s) AS popped FROM s")
def set_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word that was taken, and those that are left."""
    word, rest = WordSet(_bench_words(spark, sf_dir)).pop()
    return rest.words().withColumn("popped", F.lit(False)).unionByName(spark.createDataFrame([(word, True)], "word string, popped boolean"))


@query("wordset_cleared", f"SELECT word FROM ({_LARGE})")
def set_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, large = _halves(spark, sf_dir)
    return WordSet(small).clear().add(large).words()


@query("wordset_comparisons", f"{_SETS} SELECT (SELECT count(*) FROM s)::BIGINT AS size, NOT EXISTS ({_BOTH}) AS disjoint, NOT EXISTS ({_ONLY_S}) AS subset, NOT EXISTS ({_ONLY_L}) AS superset, true AS subset_of_union, true AS equals_itself")
def set_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, large = _halves(spark, sf_dir)
    words = WordSet(small)
    row = (words.size(), words.isdisjoint(large), words.issubset(large), words.issuperset(large), words.issubset(small.unionByName(large)), words.equals(small))
    return spark.createDataFrame([row], "size long, disjoint boolean, subset boolean, superset boolean, subset_of_union boolean, equals_itself boolean")


@query("wordset_contains", f"{_SETS}, t AS (SELECT item_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM benchmark) SELECT item_id, word, nfc_normalize({_FOLD('word')}) IN (SELECT k FROM l) AS found FROM t")
def set_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(X.words(F.col("text"))).alias("word"))
    return WordSet(_halves(spark, sf_dir)[1]).contains(asked)


# bags of words and edit distances


@query(
    "bow_distance",
    f"""WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a1, split_part(p_name, ' ', 2) AS a2, lower(p_type) AS b FROM part),
    w AS (SELECT DISTINCT unnest([a1, a2]) AS word FROM p), t AS (SELECT DISTINCT b AS word FROM p), s AS ({S.pair_similarity("w", "t")}),
    d AS (SELECT w.word AS l, t.word AS r, 1 - coalesce(sim, 0) / (len(w.word) + len(t.word) + 2) AS d FROM p x JOIN w ON w.word IN (x.a1, x.a2) JOIN t ON t.word = x.b LEFT JOIN s ON s.l = w.word AND s.r = t.word GROUP BY ALL)
    SELECT a1 || ' ' || a2 AS name, b AS type, round(round(1 + least(x.d, y.d), 9), 6) AS distance, round(round((1 + least(x.d, y.d)) / 2, 9), 6) AS distance_norm,
      round(round(1 - least(x.d, y.d), 9), 6) AS similarity, round(round((1 - least(x.d, y.d)) / 2, 9), 6) AS similarity_norm
    FROM p JOIN d x ON x.l = a1 AND x.r = b JOIN d y ON y.l = a2 AND y.r = b""",
)
def bow_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lower("p_type").alias("type")).distinct()
    a, b = F.split("name", " "), F.array("type")
    score = lambda i, n: _round(P.bow_distance_udf(a, b, invert=i, normalize=n))
    return pairs.select("name", "type", score(False, False).alias("distance"), score(False, True).alias("distance_norm"), score(True, False).alias("similarity"), score(True, True).alias("similarity_norm"))


_PAIRS = "SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part"


@query("edit_distances", f"SELECT a, b, levenshtein(a, b)::INT AS edits, {S.osa('a', 'b')}::INT AS osa FROM ({_PAIRS})")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", C.edit_distance(F.col("a"), F.col("b")).alias("edits"), C.osa_distance(F.col("a"), F.col("b")).alias("osa"))


# DuckDB measures bytes, so letters of two bytes get one each that words don't hold
_ONE_BYTE = "translate({}, '" + "".join(map(chr, range(192, 256))) + "', list_aggregate(list_transform(range(1, 32) || range(33, 48) || range(58, 65) || range(91, 97) || range(123, 128), lambda c: chr(c::INT)), 'string_agg', ''))"

for _k in (1, 2):

    @query(f"levenshtein_lookup_{_k}", f"WITH w AS (SELECT word, {_ONE_BYTE.format('word')} AS b FROM ({BENCH_WORDS})) SELECT x.word AS query, y.word AS word, levenshtein(x.b, y.b)::INT AS distance FROM w x JOIN w y ON abs(len(x.word) - len(y.word)) <= {_k} AND levenshtein(x.b, y.b) <= {_k}")
    def levenshtein_lookup(spark: SparkSession, sf_dir: str, k: int = _k) -> DataFrame:
        words = _bench_words(spark, sf_dir)
        return within_edits(words.withColumnRenamed("word", "query"), words, k)


@query("weighted_edit_lookup", f"SELECT query, word, {S.osa('query', 'word')}::DOUBLE AS distance FROM ({TYPOS}) JOIN ({NAMES}) ON {S.osa('query', 'word')} <= 2")
def weighted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_lookup(_typos(spark, sf_dir), _names(spark, sf_dir), 2, transposition_cost=1)


@query("free_swaps_lookup", f"SELECT query, word, {S.osa('query', 'word', 0)}::DOUBLE AS distance FROM ({TYPOS}) JOIN ({NAMES}) ON {S.osa('query', 'word', 0)} <= 1")
def free_swaps_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_lookup(_typos(spark, sf_dir), _names(spark, sf_dir), 1, transposition_cost=0)


@query("find_all_matches", f"SELECT word FROM ({BENCH_WORDS}) WHERE levenshtein({_ONE_BYTE.format('word')}, 'then') <= 2")
def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_all_matches("then", 2, _bench_words(spark, sf_dir))


@query("extended_edit_distance", f"WITH pairs AS (SELECT DISTINCT p_name AS hyp, lower(p_type) AS ref FROM part) SELECT hyp, ref, round(round(distance, 9), 6) AS distance FROM ({S.extended('hyp', 'ref')})")
def extended_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "part").select(F.col("p_name").alias("hyp"), F.lower("p_type").alias("ref")).distinct()
    return pairs.select("hyp", "ref", _round(P.extended_edit_distance_udf(F.col("hyp"), F.col("ref"))).alias("distance"))


# tokens, sentences, normal forms


@query("tokenize_words", f"SELECT doc_id, t.i AS i, w[t.i] AS word FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS w FROM documents), unnest(range(1, len(w) + 1)) t(i)")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.words(F.col("text"))).alias("i", "word")).withColumn("i", F.col("i").cast("long") + 1)


_TOKENS = rf"regexp_extract_all(text, '{TOKEN}|[\x{{0}}-\x{{10FFFF}}]')"


@query("token_category_counts", rf"SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^{TOKEN}') THEN 'WORD' WHEN regexp_matches(t, '^\s') THEN 'WHITESPACE' ELSE 'PUNCTUATION' END AS category, count(*) AS n FROM (SELECT conv_id, turn, unnest({_TOKENS}) AS t FROM conversations) GROUP BY ALL")
def token_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(X.token_texts(F.col("text"))).alias("t"))
    return tokens.groupBy("conv_id", "turn", X.category(F.col("t")).alias("category")).agg(F.count("*").alias("n"))


@query("tokenize_tokens", rf"""WITH t AS (SELECT item_id, {_TOKENS} AS w FROM benchmark), p AS (SELECT item_id, i, w[i] AS text, coalesce(list_sum(list_transform(w[1:i-1], lambda x: len(x))), 0)::INT AS start_pos FROM t, unnest(range(1, len(w) + 1)) u(i))
    SELECT item_id, text, start_pos, CASE WHEN regexp_matches(text, '^{TOKEN}') THEN 'WORD' WHEN regexp_matches(text, '^\s') THEN 'WHITESPACE' ELSE 'PUNCTUATION' END AS category FROM p""")
def tokenize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select("item_id", F.explode(X.tokens(F.col("text"))).alias("t")).select("item_id", "t.*")


_W, _A = r"\p{L}\p{M}\p{N}\p{Co}", "".join(f"\\x{{{ord(c):x}}}" for c in X.APOSTROPHES)


@query("tokenize_merged_apostrophes", f"""SELECT conv_id, turn, t.i AS i, w[t.i] AS word FROM (SELECT conv_id, turn, flatten(list_transform(regexp_extract_all(text, '[{_W}{_A}]+'),
    lambda r: CASE WHEN regexp_full_match(r, '[{_W}]+[{_A}][{_W}]+') THEN [r] ELSE regexp_extract_all(r, '[{_W}]+') END)) AS w FROM conversations), unnest(range(1, len(w) + 1)) t(i)""")
def tokenize_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, two of them as one where a single apostrophe stands between."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.words(F.col("text"), merge_apostrophe_word=True)).alias("i", "word")).withColumn("i", F.col("i").cast("long") + 1)


def _in(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


@query("character_classes", rf"""SELECT c AS char, regexp_matches(c, '^[\p{{L}}\p{{M}}]$') AS is_word, regexp_matches(c, '^{TOKEN[:-1]}$') AS is_text, regexp_matches(c, '^[{_in(X.SPACES)}]$') AS is_space,
    regexp_matches(c, '^(?:[\p{{P}}\p{{S}}]|[{_in(X.UNPRINTABLE + X.CLOSING)}])$') AS is_punctuation FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\x{{0}}-\x{{10FFFF}}]')) AS c FROM documents)""")
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _t(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("char")).filter("char <> ''").distinct()
    kinds = {"is_word": X.is_word_char, "is_text": X.is_text_char, "is_space": X.is_space_char, "is_punctuation": X.is_punctuation_char}
    return chars.withColumns({name: kind(F.col("char")) for name, kind in kinds.items()})


_SENTENCES = r"""SELECT {keep}, trim(unnest(regexp_extract_all(trim(para), '[\x{{0}}-\x{{10FFFF}}]*?[!.:;?][")>\]}}]*\s|[\x{{0}}-\x{{10FFFF}}]+'))) AS sentence FROM (SELECT {keep}, unnest(string_split(text, chr(10))) AS para FROM {table})"""


@query("sentence_split", f"SELECT doc_id, sentence, count(*) AS n FROM ({_SENTENCES.format(keep='doc_id', table='documents')}) WHERE sentence <> '' GROUP BY ALL")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(X.sentence_split(F.col("text"))).alias("sentence")).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


_RAW = _SENTENCES.replace("trim(unnest(", "unnest((")


@query("sentence_tokens", f"""WITH t AS (SELECT item_id, regexp_extract_all(sentence, '{TOKEN}|[\\x{{0}}-\\x{{10FFFF}}]') AS w FROM ({_RAW.format(keep="item_id", table="benchmark")})),
    p AS (SELECT item_id, w[i] AS text, coalesce(list_sum(list_transform(w[1:i-1], lambda x: len(x))), 0)::INT AS start_pos FROM t, unnest(range(1, len(w) + 1)) u(i)) SELECT item_id, text, start_pos, count(*) AS n FROM p GROUP BY ALL""")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(F.flatten(X.sentence_split_tokens(F.col("text")))).alias("t"))
    return tokens.groupBy("item_id", "t.text", "t.start_pos").agg(F.count("*").alias("n"))


@query("word_bigrams", f"SELECT w[i] AS first, w[i + 1] AS second, count(*) AS n FROM (SELECT regexp_extract_all(sentence, '{TOKEN}') AS w FROM ({_SENTENCES.format(keep='item_id', table='benchmark')})), unnest(range(1, len(w))) t(i) GROUP BY ALL")
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "benchmark").select(F.explode(X.word_n_grams(F.col("text"), 2)).alias("g"))
    return pairs.groupBy(F.col("g")[0].alias("first"), F.col("g")[1].alias("second")).agg(F.count("*").alias("n"))


@query("char_ngrams", "SELECT substring(text, i::INT, 3) AS gram, count(*) AS n FROM conversations, unnest(range(1, len(text) - 1)) t(i) GROUP BY ALL")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(F.explode(X.text_n_grams(F.col("text"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("casefold", f"SELECT DISTINCT word, replace(lower(word), 'ß', 'ss') AS folded FROM ({DOC_WORDS})")
def casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_words(spark, sf_dir).distinct().withColumn("folded", X.casefold(F.col("word")))


@query("normalize_nfc", f"SELECT DISTINCT word, nfc_normalize(word) AS nfc FROM ({DOC_WORDS})")
def normalize_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_words(spark, sf_dir).distinct().withColumn("nfc", X.normalize_nfc(F.col("word")))


@query("normalize_nfkc", f"SELECT DISTINCT word, nfc_normalize(word) AS nfkc FROM ({DOC_WORDS})")  # these words have no compatibility forms
def normalize_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_words(spark, sf_dir).distinct().withColumn("nfkc", X.normalize_nfkc(F.col("word")))


@query("strip_marks", f"SELECT DISTINCT word, strip_accents(word) AS plain FROM ({DOC_WORDS})")
def strip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_words(spark, sf_dir).distinct().withColumn("plain", X.normalize_nfd_strip_marks(F.col("word")))


# patterns

_LONGEST_FIRST = "|".join(sorted(KEYS, key=lambda k: (-len(k), k)))


def _patterns() -> PatternSet:
    return PatternSet(REPLACED)


@query("trie_findall", f"SELECT doc_id, m AS match, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_LONGEST_FIRST}')) AS m FROM documents) GROUP BY ALL")
def trie_findall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _t(spark, sf_dir, "documents").select("doc_id", F.explode(_patterns().findall_column(F.col("text"))).alias("match"))
    return found.groupBy("doc_id", "match").agg(F.count("*").alias("n"))


@query("trie_count", f"SELECT doc_id, len(regexp_extract_all(text, '{_LONGEST_FIRST}'))::INT AS n FROM documents")
def trie_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", _patterns().count_column(F.col("text")).alias("n"))


@query("trie_overlapping", "SELECT item_id, (i - 1)::INT AS start, (i - 1 + len(k))::INT AS \"end\", k AS match FROM benchmark, (SELECT unnest([" + ", ".join(f"'{k}'" for k in KEYS) + "]) AS k), unnest(range(1, len(text) + 1)) t(i) WHERE substring(text, i::INT, len(k)::INT) = k")
def trie_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns().match_table(_t(spark, sf_dir, "benchmark"), "text", "item_id", allow_overlapping=True)


_BY_LENGTH = "[" + ", ".join(f"'{k}'" for k in sorted(KEYS, key=lambda k: (-len(k), k))) + "]"


@query(
    "trie_longest",
    # the best choice for each beginning of a text: what is best without its last letter, or a key at its end that makes more; of equal ones the longer key
    f"""WITH keys AS (SELECT {_BY_LENGTH} AS k), best AS (SELECT item_id, list_last(list_reduce(range(1, len(text) + 1), lambda b, e: list_append(b, list_transform([list_reduce(range(1, len(k) + 1), lambda x, j:
      CASE WHEN e >= len(k[j]) AND substring(text, (e + 1 - len(k[j]))::INT, len(k[j])::INT) = k[j] AND b[(e + 1 - len(k[j]))::INT].t + len(k[j]) > x.t THEN {{'t': b[(e + 1 - len(k[j]))::INT].t + len(k[j]), 's': b[(e + 1 - len(k[j]))::INT].s || ',' || k[j]}} ELSE x END, b[e::INT])], lambda x: x)[1]),
      [{{'t': 0::BIGINT, 's': ''}}])).s AS s FROM benchmark, keys)
    SELECT item_id, m AS match, count(*) AS n FROM (SELECT item_id, unnest(string_split(s, ',')) AS m FROM best) WHERE m <> '' GROUP BY ALL""",
)
def trie_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(_patterns().findall_longest_column(F.col("text"))).alias("match"))
    return found.groupBy("item_id", "match").agg(F.count("*").alias("n"))


@query("trie_translate", f"SELECT conv_id, turn, list_aggregate(list_transform(regexp_extract_all(text, '{_LONGEST_FIRST}|[\\x{{0}}-\\x{{10FFFF}}]'), lambda t: CASE WHEN t IN (" + ", ".join(f"'{k}'" for k in KEYS) + ") THEN '<' || upper(t) || '>' ELSE t END), 'string_agg', '') AS text FROM conversations")
def trie_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", _patterns().translate_column(F.col("text")).alias("text"))


@query("trie_regex", f"SELECT doc_id, len(regexp_extract_all(text, '{_LONGEST_FIRST}'))::INT AS n FROM documents")
def trie_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(_patterns().to_regex())).alias("n"))


@query("trie_items", "SELECT DISTINCT p_type AS \"key\", max(p_brand) AS replacement FROM part GROUP BY 1")
def trie_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.from_table(_t(spark, sf_dir, "part"), "p_type", "p_brand").table(spark)


# ranked dictionaries


@query("dictionary_ranks", f"SELECT row_number() OVER (ORDER BY word) - 1 AS rank, word, min(data) AS data FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS word, doc_id AS data FROM documents) GROUP BY word")
def dictionary_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("word"), F.col("doc_id").alias("data"))
    return RankedDictionary(words, data="data").table


@query("dictionary_index", f"SELECT item_id, word, coalesce(rank, -1) AS rank FROM (SELECT item_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM benchmark) b LEFT JOIN (SELECT word AS w, row_number() OVER (ORDER BY word) - 1 AS rank FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM conversations)) ON w = word")
def dictionary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "conversations").select(F.explode(X.words(F.col("text"))).alias("word"))
    asked = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(X.words(F.col("text"))).alias("word"))
    return RankedDictionary(words).index(asked)


_DICTIONARY = f"SELECT row_number() OVER (ORDER BY word) - 1 AS rank, word FROM ({BENCH_WORDS})"


@query("dictionary_prefix", f"SELECT rank, word FROM ({_DICTIONARY}) WHERE starts_with(word, 'th')")
def dictionary_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RankedDictionary(_bench_words(spark, sf_dir)).prefix("th").select("rank", "word")


@query("dictionary_between", f"SELECT rank, word FROM ({_DICTIONARY}) WHERE word >= 'he' AND word < 'on'")
def dictionary_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RankedDictionary(_bench_words(spark, sf_dir)).between("he", "on").select("rank", "word")


@query("dictionary_word_at", f"SELECT s_suppkey, word FROM supplier LEFT JOIN ({_DICTIONARY}) ON rank = s_suppkey")
def dictionary_word_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RankedDictionary(_bench_words(spark, sf_dir)).word_at(_t(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


@query("text_replace_pages", f"SELECT page_id, list_aggregate(list_transform(regexp_extract_all(html, '{_LONGEST_FIRST}|[\\x{{0}}-\\x{{10FFFF}}]'), lambda t: CASE WHEN t IN (" + ", ".join(f"'{k}'" for k in KEYS) + ") THEN '<' || upper(t) || '>' ELSE t END), 'string_agg', '') AS html FROM pages")
def text_replace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", _patterns().translate_column(F.col("html")).alias("html"))


@query("source_replaced_files", "SELECT DISTINCT replace(p_name, 'e', '3') AS line FROM part")
def replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _own_folder(spark)
    write_words(_names(spark, sf_dir), f"{path}/from")
    replace_files(spark, f"{path}/from", f"{path}/to", PatternSet({"e": "3"}))
    return spark.read.text(f"{path}/to").select(F.col("value").alias("line")).distinct()


@query("trie_search", f"SELECT doc_id, nullif(regexp_extract(text, '{_LONGEST_FIRST}'), '') AS match FROM documents")
def trie_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", _patterns().search_column(F.col("text")).alias("match"))


@query("trie_findall_folded", f"SELECT doc_id, m AS match, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD('text')}, '{_LONGEST_FIRST}')) AS m FROM documents) GROUP BY ALL")
def trie_findall_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = PatternSet.fromkeys([k.upper() for k in KEYS], case_sensitive=False)
    found = _t(spark, sf_dir, "documents").select("doc_id", F.explode(folded.findall_column(F.col("text"))).alias("match"))
    return found.groupBy("doc_id", "match").agg(F.count("*").alias("n"))


@query(
    "trie_changes",
    """WITH b AS (SELECT p_name AS k, max(p_brand) AS v FROM part GROUP BY 1), u AS (SELECT k, CASE WHEN k = (SELECT max(k) FROM b) THEN 'changed' ELSE v END AS v FROM b UNION ALL SELECT 'zz', 'new'),
    d AS (SELECT * FROM u WHERE NOT (k >= 'm' AND k < 'r')) SELECT k AS "key", v AS replacement, k >= 'b' AND k < 'c' AS sliced FROM d WHERE k <> (SELECT min(k) FROM d)""",
)
def trie_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from a table, updated, with a default that is there already and one that isn't, a slice deleted, and the first key popped."""
    all_ = PatternSet.from_table(_t(spark, sf_dir, "part"), "p_name", "p_brand")
    last = all_.keys()[-1]
    _, some = all_.update({last: "changed"}).setdefault("zz", "new").setdefault(last, "not this").delete(slice("m", "r")).pop()
    sliced = {k for k in some.keys() if some.get(k) in some["b":"c"] and "b" <= k < "c"}
    return some.table(spark).withColumn("sliced", F.col("key").isin(*sliced) if sliced else F.lit(False))


def _tokenizer(text: str) -> list[str]:
    return text.split()


@query("trie_tokens", "SELECT conv_id, turn, trim(m) AS match, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all('  ' || list_aggregate(regexp_extract_all(text, '[^ \\t-\\r]+'), 'string_agg', '  ') || '  ', ' (?:of  the|of|the|and|in) ')) AS m FROM conversations) GROUP BY ALL")
def trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of whole words, by a tokenizer: the longest run of words at each place."""
    keys = PatternSet.fromkeys(["of the", "of", "the", "and", "in"])
    words = PatternSet(keys.items(), tokenizer=_tokenizer)
    found = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(words.findall_column(F.col("text"))).alias("m"))
    return found.groupBy("conv_id", "turn", F.replace("m", F.lit(" "), F.lit("  ")).alias("match")).agg(F.count("*").alias("n"))


@query("trie_regex_options", r"SELECT item_id, len(regexp_extract_all(text, 'th(?:e(?:re)?|[is])|(?:a|e)n\s+'))::INT AS n FROM benchmark")
def trie_regex_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression with fuzzy white space, not simplified."""
    keys = PatternSet.fromkeys(["the", "there", "thi", "ths", "an  ", "en  "])
    return _t(spark, sf_dir, "benchmark").select("item_id", F.regexp_count("text", F.lit(keys.to_regex(simplify=False))).alias("n"))


@query("dictionary_automaton", f"""WITH w AS (SELECT DISTINCT word FROM ({BENCH_WORDS})), s AS (SELECT substring(word, 1, i::INT) AS head, substring(word, i::INT + 1) AS tail FROM w, unnest(range(1, len(word) + 1)) t(i)),
    n AS (SELECT DISTINCT list_sort(list(tail)) AS tails FROM s GROUP BY head) SELECT count(*) AS nodes, sum(len(list_distinct(list_transform(list_filter(tails, lambda x: x <> ''), lambda x: x[1]))))::BIGINT AS edges FROM n""")
def dictionary_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = RankedDictionary(_bench_words(spark, sf_dir))
    return spark.createDataFrame([(words.count_nodes(), words.count_edges())], "nodes long, edges long")


@query("dictionary_lookup", f"SELECT item_id, b.word, coalesce(data, -1)::BIGINT AS data, data IS NOT NULL AS found FROM (SELECT item_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM benchmark) b LEFT JOIN (SELECT word, min(conv_id) AS data FROM (SELECT conv_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM conversations) GROUP BY 1) c ON c.word = b.word")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "conversations").select(F.explode(X.words(F.col("text"))).alias("word"), F.col("conv_id").alias("data"))
    asked = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(X.words(F.col("text"))).alias("word"))
    known = RankedDictionary(words, data="data")
    return known.contains(known.lookup(asked)).withColumn("data", F.coalesce("data", F.lit(-1)).cast("long"))


@query("dictionary_items", f"SELECT row_number() OVER (ORDER BY word) - 1 AS rank, word, min(data) AS data FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS word, conv_id AS data FROM conversations) GROUP BY word")
def dictionary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "conversations").select(F.explode(X.words(F.col("text"))).alias("word"), F.col("conv_id").alias("data"))
    return RankedDictionary(words, data="data").items()
