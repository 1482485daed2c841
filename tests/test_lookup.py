"""Dictionary lookup, word sets and similarity joins."""

import pytest
from pyspark.sql import functions as F

from gramloom.functions import pairs as P
from gramloom.functions import text as X
from gramloom.operators.dictionary import RankedDictionary, edit_lookup, find_all_matches, within_edits
from gramloom.operators.fuzzy_join import fuzzy_self_join
from gramloom.operators.lookup import GramIndex
from gramloom.operators.word_set import WordSet
from gramloom.plans.settle import numbered

WORDS = "banana bandana ananas cabana havana hello yellow mellow jello cello blackberry chromosome chrysanthemum installation cartwheel bewilderment assalamualaikum waalaikumsalam".split()
#: query: (word, score, sim2) normalised
KNOWN = {
    "asalamalaikum": [("assalamualaikum", 0.692449, 0.855043), ("waalaikumsalam", 0.509764, 0.654983), ("chrysanthemum", 0.103022, 0.206044)],
    "walaikumalasam": [("waalaikumsalam", 0.566484, 0.838095), ("assalamualaikum", 0.432505, 0.645161)],
    "bananana": [("banana", 0.828559, 0.851562), ("bandana", 0.503636, 0.69958), ("ananas", 0.407986, 0.489583)],
    "blackbary": [("blackberry", 0.608862, 0.753439)],
    "chomosrome": [("chromosome", 0.500821, 0.786364), ("chrysanthemum", 0.079538, 0.159077)],
    "yelow": [("yellow", 0.676068, 0.907692), ("mellow", 0.412393, 0.602564)],
}


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([*enumerate(WORDS), (99, "Banana"), (100, None)], "o int, word string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(q,) for q in [*KNOWN, "xy", None]], "query string")


@pytest.fixture(scope="module")
def index(vocab):
    return GramIndex.build(vocab, order="o")


def found(df, *cols):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["word"], *(pytest.approx(r[c], abs=1e-6) for c in cols)))
    return out


@pytest.mark.parametrize("prune", [False, True])
def test_known_lookups(index, asked, prune):
    got = found(index.lookup(asked, top_k=3, normalize=True, prune=prune), "score", "sim2")
    assert got == KNOWN


def test_raw_lookup(index, asked):
    got = found(index.lookup(asked.filter("query = 'yelow'"), top_k=3), "score", "sim2")
    assert got == {"yelow": [("yellow", 7.9, 11.8), ("mellow", 4.916667, 7.833333)]}


def test_sizes_and_dim(vocab, index, asked):
    one = asked.filter("query = 'bananana'")
    all_n = GramIndex.build(vocab, n=(4, 3, 2, 1, 2), order="o")
    assert all_n.ngram_sizes == (1, 2, 3, 4)
    assert found(all_n.lookup(one, top_k=3, normalize=True), "score")["bananana"] == [("banana", 0.784348), ("bandana", 0.540373), ("ananas", 0.442315)]
    assert found(index.lookup(one, top_k=3, normalize=True, dim=2), "score")["bananana"] == [("banana", 0.828878), ("bandana", 0.54041), ("ananas", 0.416066)]


def test_scorings(index, asked):
    assert index.lookup(asked, top_k=1, normalize=True, scoring="v5b").filter("query = 'bananana'").count() == 1
    assert index.lookup(asked, top_k=1, normalize=True, scoring="v5").filter("query = 'bananana'").count() == 2
    far = found(index.lookup(asked, top_k=1, normalize=True, scoring="v5", invert=False), "score")
    assert far["bananana"] == [("banana", 1 - 0.828559), ("bandana", 1 - 0.503636)]
    every = index.lookup(asked, top_k=0, scoring="v3")
    assert every.filter("query = 'bananana'").count() > 5
    for bad in ({"scoring": "v1"}, {"dim": 0}, {"top_k": 0}):
        with pytest.raises(ValueError):
            index.lookup(asked, **bad)


def test_short_words(spark):
    words = spark.createDataFrame([("a",), ("ab",), ("abc",)], "word string")
    got = found(GramIndex.build(words, filter_n=0).lookup(words.withColumnRenamed("word", "query"), normalize=True, top_k=1), "score")
    assert [v[0][0] for _, v in sorted(got.items())] == ["a", "ab", "abc"]


def test_index_changes(spark, index, tmp_path):
    assert index.size() == 18 and [r.word for r in index.vocabulary.limit(2).collect()] == ["ananas", "assalamualaikum"]
    more = index.add(spark.createDataFrame([("Banana",), ("bananana",)], "word string"))
    assert more.size() == 19 and more.vocab_table.agg(F.max("word_id")).first()[0] == 18
    assert more.lookup(spark.createDataFrame([("bananana",)], "query string"), top_k=1, normalize=True).first().word == "bananana"
    more.save(str(tmp_path / "index"))
    again = GramIndex.load(spark, str(tmp_path / "index"))
    assert (again.ngram_sizes, again.case_sensitive, again.filter_ngram_size, again.size()) == ((2, 4), False, 3, 19)
    assert [r.found for r in again.contains(spark.createDataFrame([("BANANA",), ("x",)], "word string").coalesce(1)).orderBy("word").collect()] == [True, False]
    for bad in ("", "a\x02"):
        with pytest.raises(Exception, match="not a word"):
            GramIndex.build(spark.createDataFrame([(bad,)], "word string"))
    with pytest.raises(ValueError):
        GramIndex.build(spark.createDataFrame([("a",)], "word string"), n=())
    assert GramIndex.build(spark.createDataFrame([], "word string")).lookup(spark.createDataFrame([("abc",)], "query string")).count() == 0


def test_word_set(spark, vocab, asked):
    words = WordSet(vocab.filter("o < 99"))
    got = found(words.find_similar(asked, k=3), "similarity")
    assert got["asalamalaikum"] == [("assalamualaikum", 0.704069), ("waalaikumsalam", 0.508141), ("chrysanthemum", 0.099606)]
    assert got["bananana"] == [("banana", 0.832115), ("bandana", 0.529894), ("ananas", 0.419218)]
    assert got["yelow"] == [("yellow", 0.718182), ("mellow", 0.417677)]
    assert "xy" not in got
    assert words.find_similar(asked, min_similarity=0.7).filter("query = 'bananana'").count() == 1
    assert words.suggest(asked, k=1).filter("query = 'yelow'").first().word == "yellow"
    table = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert len(words) == 18 and len(words.add(table("HELLO", "new"))) == 19 and len(words.discard(table("Hello", "zzz"))) == 17
    with pytest.raises(KeyError):
        words.remove(table("zzz"))
    few = WordSet(table("b", "A"))
    assert few.filter_n == 3 and WordSet(table("b"), ngram_sizes=5).filter_n is None
    assert [r.word for r in few.words().collect()] == ["A", "b"]
    assert few.pop()[0] == "A" and len(few.pop()[1]) == 1 and len(few.clear()) == 0
    assert few.isdisjoint(table("c")) and few.issubset(table("a", "B", "c")) and few.issuperset(table("a")) and few.equals(table("a", "b"))
    assert sorted(r.word for r in few.symmetric_difference(table("B", "c")).words().collect()) == ["A", "c"]
    assert [r.word for r in few.intersection(table("B")).words().collect()] == ["b"]
    assert [r.found for r in few.contains(table("a", "x")).orderBy("word").collect()] == [True, False]
    assert len(WordSet(table("é", "é"))) == 1 and len(WordSet(table("é", "e"), unicode_normalizer=X.normalize_nfd_strip_marks)) == 1
    none = WordSet(table("abcdef", "xyz"), ngram_sizes=5).find_similar(spark.createDataFrame([("abcdeg",)], "query string"))
    assert [r.word for r in none.orderBy("rank").collect()] == ["abcdef", "xyz"]
    with pytest.raises(TypeError):
        WordSet(table("a"), case_sensitive=1)


def test_fuzzy_self_join(spark, vocab):
    for least in (0.3, 0.6, 1.0):
        got = {(r.left, r.right) for r in fuzzy_self_join(vocab, least).collect()}
        names = sorted({*WORDS, "Banana"})
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if P.gram_movers_distance(a, b, 2, True, True) >= least}
        assert got == want
    with pytest.raises(ValueError):
        fuzzy_self_join(vocab, 0)


def test_edits(spark, vocab):
    q = spark.createDataFrame([("hallo",), ("",), ("bnaana",)], "query string")
    for k in range(4):
        want = {(a, b, P.weighted_edit_distance(a, b)) for a in ("hallo", "", "bnaana") for b in {*WORDS, "Banana"} if P.weighted_edit_distance(a, b) <= k}
        assert {tuple(r) for r in within_edits(q, vocab, k).collect()} == want
    one = {(r["query"], r.word, r.distance) for r in edit_lookup(q, vocab, 1, transposition_cost=1).collect()}
    assert one == {("hallo", "hello", 1.0), ("bnaana", "banana", 1.0)}
    assert [r.word for r in find_all_matches("jallo", 2, vocab).collect()] == ["cello", "hello", "jello"]
    with pytest.raises(ValueError):
        edit_lookup(q, vocab, 1, insertion_cost=0)


def test_ranks(spark, vocab):
    d = RankedDictionary(vocab.filter("word is not null"), data="o")
    ranks = {r.word: r["rank"] for r in d.items().collect()}
    assert ranks == {w: i for i, w in enumerate(sorted({*WORDS, "Banana"}))} and d.size() == 19
    t = spark.createDataFrame([("hello",), ("zzz",)], "word string")
    assert {r.word: r["rank"] for r in d.index(t).collect()} == {"hello": ranks["hello"], "zzz": -1}
    assert {r.word: r.data for r in d.lookup(t).collect()} == {"hello": 5, "zzz": None}
    assert {r["rank"]: r.word for r in d.word_at(spark.createDataFrame([(0,), (50,)], "rank int")).collect()} == {0: "Banana", 50: None}
    assert [r.word for r in d.prefix("ba").collect()] == ["banana", "bandana"]
    assert [r.word for r in d.between("c", "ch").collect()] == ["cabana", "cartwheel", "cello"]


def test_numbers_are_dense(spark):
    df = spark.range(1000).withColumn("v", F.xxhash64("id"))
    rows = numbered(df.repartition(7), [F.col("v")], "n", 5).orderBy("v").collect()
    assert [r.n for r in rows] == list(range(5, 1005))


def test_columns_of_inner_names_stay(spark):
    """Tables may have columns named like inner ones."""
    own = {"_w": 1, "_f": 2, "_n": 3, "_r": 4, "_m": 5, "_key": 6, "_hit": 7, "_at": 8, "_part": 9, "_base": 10, "_each": 11}
    df = spark.createDataFrame([("apple",), ("pear",)], "word string").withColumns({k: F.lit(v) for k, v in own.items()})
    words = spark.createDataFrame([("apple", 1)], "word string, data int")
    for found in (GramIndex.build(words).contains(df), WordSet(words).contains(df), RankedDictionary(words, data="data").contains(df), RankedDictionary(words, data="data").lookup(df), RankedDictionary(words).index(df)):
        assert [c for c in found.columns if c in own] == [*own] and all(tuple(r[c] for c in own) == tuple(own.values()) for r in found.collect())
    at = RankedDictionary(words).word_at(df.select(F.lit(0).alias("rank"), *own)).collect()
    assert {r.word for r in at} == {"apple"} and at[0]["_r"] == 4


def test_swaps_may_be_free(spark):
    import itertools

    from gramloom.functions.pairs import weighted_edit_distance

    words = ["".join(x) for n in (1, 2, 3) for x in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for distance, swap in ((0, 0), (1, 0), (1, 0.25)):
        got = {(r["query"], r.word): r.distance for r in edit_lookup(df.withColumnRenamed("word", "query"), df, distance, transposition_cost=swap).collect()}
        want = {(a, b): d for a in words for b in words if (d := weighted_edit_distance(a, b, transposition=swap)) <= distance}
        assert got == want
    with pytest.raises(ValueError):
        edit_lookup(df.withColumnRenamed("word", "query"), df, 1, insertion_cost=0)


def test_states_of_the_least_automaton(spark):
    words = ["tap", "taps", "top", "tops", "a", "aps"]
    ends = {}
    for w in words:
        for i in range(1, len(w) + 1):
            ends.setdefault(w[:i], set()).add(w[i:])
    states = {frozenset(x) for x in ends.values()}
    known = RankedDictionary(spark.createDataFrame([(w,) for w in words], "word string"))
    assert (known.count_nodes(), known.count_edges()) == (len(states), sum(len({t[0] for t in s if t}) for s in states))
    none = RankedDictionary(spark.createDataFrame([], "word string"))
    assert (none.count_nodes(), none.count_edges()) == (0, 0)


def test_compact_keeps_results(spark, vocab, asked):
    index = GramIndex.build(vocab.filter("o < 3")).add(vocab)
    same = index.compact()
    assert sorted(map(tuple, index.lookup(asked).collect())) == sorted(map(tuple, same.lookup(asked).collect()))
