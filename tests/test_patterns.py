"""Search and replacement of many patterns, sources and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gramloom.operators.lookup import GramIndex
from gramloom.operators.patterns import PatternSet, keys_to_regex
from gramloom.sources.text import read_first_fields, read_words, replace_files, write_words
from gramloom.streaming.lookup import GrowingIndex, lookup_stream, translate_stream


def test_translate():
    p = PatternSet({"asd": "111", "hjk": "222", "dfgh": "3333", "ghjkl;": "44444", "jkl": "!"})
    assert [p.translate(x) for x in ("erasdfghjkll", "erasdfghjkl;jkl;", "erassdfghjkl;jkl;", "ersdfghjkll")] == ["er111fg222ll", "er111f44444!;", "erass3333!;!;", "ers3333!l"]
    assert PatternSet({"a": "b", "b": "c", "c": "d", "d": "a"}).translate("acbd") == "bdca"


def test_changes():
    p = PatternSet({"aa": "2", "aaa": "3", "a" * 22: "~", "bbbb": "!"})
    assert "a" * 7 not in p and len(p) == 4
    p = p.set("a" * 7, "7")
    assert [p.translate(x) for x in ("a" * 12 + "b" + "a" * 28, "a" * 40, "a" * 45, "a" * 25, "a" * 60)] == ["732b~33", "~773a", "~~a", "~3", "~~772"]
    p = p.delete("bbbb").delete("a" * 7).set("aaaa", "4").delete("a" * 22)
    assert p["aaa":"bbb"] == ["3", "4"] and p.setdefault("aa", "x")["aa"] == "2"
    p = p.delete(slice("aaa", "bbb"))
    assert (p.to_regex(), len(p), p.get("zz", 0), p.pop()[0]) == ("(?:aa)", 1, 0, "2")
    with pytest.raises(KeyError):
        p.delete("zz")
    with pytest.raises(ValueError):
        PatternSet({"": "x"})


def test_find():
    t = PatternSet.fromkeys("mad gas scar madagascar scare care car career error err are".split())
    assert t.findall("madagascareerror") == t.findall_longest("madagascareerror") == ["madagascar", "error"]
    assert t.findall("madagascareerror", True) == ["mad", "gas", "madagascar", "scar", "car", "scare", "care", "are", "career", "err", "error"]
    t = PatternSet.fromkeys("to toga get her here there gather together hear the he ear".split())
    assert t.findall("togethere") == ["together"] and t.findall("togethear") == ["to", "get", "hear"]
    assert t.findall("togethere", True) == ["to", "get", "the", "he", "together", "her", "there", "here"]
    assert t.findall("togethear", True) == ["to", "get", "the", "he", "hear", "ear"]
    assert [m.span() for m in PatternSet.fromkeys(["asdf"]).finditer("asdfasdfqweasdf")] == [(0, 4), (4, 8), (11, 15)]
    assert PatternSet.fromkeys(["asdf"]).search("xx") is None


def test_tokens_and_case():
    p = PatternSet({"new york": "NYC", "york": "Y"}, tokenizer=lambda t: re.findall(r"\w+|\W", t))
    assert p.translate("new york, newyork york") == "NYC, newyork Y"
    assert PatternSet({"AB": "x"}, case_sensitive=False).findall("abAB") == ["ab", "ab"]


def test_longest_is_best():
    r = random.Random(3)
    for _ in range(200):
        keys = {"".join(r.choices("ab", k=r.randint(1, 4))) for _ in range(4)}
        p, text = PatternSet.fromkeys(keys), "".join(r.choices("abc", k=12))
        best = [0] * (len(text) + 1)
        for i in range(1, len(text) + 1):
            best[i] = max([best[i - 1], *(best[i - len(k)] + len(k) for k in keys if text[:i].endswith(k))])
        assert sum(map(len, p.findall_longest(text))) == best[-1]


def test_regex_finds_the_same():
    r = random.Random(4)
    for alphabet in ("abcde", "*.|\\[]()?+^$- '\"") * 40:
        keys = {"".join(r.choices(alphabet, k=r.randint(1, 4))) for _ in range(8)} if len(alphabet) > 1 else {alphabet}
        p, text = PatternSet.fromkeys(keys), "".join(r.choices("abcde*.|\\[]()?+^$- '\"", k=40))
        assert re.findall(p.to_regex(fuzzy_spaces=False), text) == p.findall(text)
    t = PatternSet.fromkeys("| \\ \\| |\\ [ () (][) ||| *** *.* **| \\'\\' (?:?) \0".split())
    assert re.findall(t.to_regex(), "***|\\||||") == ["***", "|\\", "|||", "|"]
    fuzzy = re.compile(PatternSet.fromkeys(["a  b", "it’s", "x�z"]).to_regex())
    assert all(fuzzy.fullmatch(x) for x in ("a b", "a \t b", "it's", "it’s", "xyz")) and not fuzzy.fullmatch("ab")
    assert re.findall(PatternSet.fromkeys(["cat"]).to_regex(boundary=True), "cat cats") == ["cat"]
    assert re.fullmatch(keys_to_regex(["Ab"]), "ab")


def test_both_ways_to_search_agree(monkeypatch):
    from gramloom.operators import patterns

    r, found = random.Random(6), []
    cases = [({"".join(r.choices("ab.( \n", k=r.randint(1, 5))) for _ in range(9)}, "".join(r.choices("abc.( \n", k=60))) for _ in range(200)]
    for limit in (1000, 0):
        monkeypatch.setattr(patterns, "MAX_REGEX_KEYS", limit)
        found.append([[*PatternSet.fromkeys(keys).finditer(text)] for keys, text in cases])
    assert found[0] == found[1]


def test_columns(spark):
    p = PatternSet({"the": "T", "there": "R", "he": "H"})
    df = spark.createDataFrame([(1, "there the he"), (2, None), (3, "")], "i int, t string")
    rows = df.select("i", p.translate_column(F.col("t")).alias("x"), p.findall_column(F.col("t")).alias("f"), p.findall_longest_column(F.col("t")).alias("l"), p.count_column(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.x for r in rows] == ["R T H", None, ""] and rows[0].f == ["there", "the", "he"] == rows[0].l and rows[0].n == 3
    assert [tuple(r) for r in p.match_table(df, "t", "i").orderBy("start").collect()] == [(1, 0, 5, "there"), (1, 6, 9, "the"), (1, 10, 12, "he")]
    again = PatternSet.from_table(p.table(spark))
    assert again.items() == p.items()


def test_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("one two\n\n three,x\n")
    words = read_words(spark, str(tmp_path / "in.txt"))
    assert sorted(r.word for r in words.collect()) == ["one", "three,x", "two"]
    assert [r.word for r in read_first_fields(spark, str(tmp_path / "in.txt")).collect()] == ["one two", "three"]
    write_words(words, str(tmp_path / "words"))
    assert read_words(spark, str(tmp_path / "words")).count() == 3
    p = PatternSet({"two": "2"})
    for _ in range(2):  # the second time the target is there, and stays
        replace_files(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), p)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["one 2", "", " three,x"]
    replace_files(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), PatternSet({"one": "1"}), overwrite=True)
    assert spark.read.text(str(tmp_path / "out")).first().value == "1 two"


def test_streams(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.txt").write_text("helo\nyelow\n")
    index = GramIndex.build(spark.createDataFrame([("hello",), ("yellow",)], "word string"))
    seen = []
    stream = spark.readStream.text(str(tmp_path / "q"))
    run = lookup_stream(stream, index, lambda df, n: seen.extend((r["query"], r.word) for r in df.collect()), word="value", top_k=1).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(seen) == [("helo", "hello"), ("yelow", "yellow")]
    growing = GrowingIndex(index)
    run = growing.add_stream(stream, "value").start()
    run.processAllAvailable()
    run.stop()
    assert growing.index.size() == 4
    run = translate_stream(stream, PatternSet({"elo": "*"})).writeStream.format("memory").queryName("translated").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.value for r in spark.table("translated").collect()) == ["h*", "y*w"]


def test_matches_answer_like_those_of_regular_expressions():
    (m,) = PatternSet.from_keys(["the"]).finditer("a the b")
    assert (m.start(), m.end(), m.span(), m.regs, m.str, m.group(), m[0], str(m), len(m)) == (2, 5, (2, 5), ((2, 5),), "the", "the", "the", "the", 3)
    for f in (m.start, m.end, m.span, m.group):
        with pytest.raises(IndexError):
            f(1)


def test_case_folding_in_columns(spark):
    p = PatternSet.fromkeys(["straße", "K"], case_sensitive=False)
    df = spark.createDataFrame([("die straße und STRASSE, \u212a",), (None,), ("",)], "t string")
    rows = df.select(p.count_column(F.col("t")).alias("n"), p.findall_column(F.col("t")).alias("m"), p.search_column(F.col("t")).alias("s")).collect()
    assert [(r.n, r.m, r.s) for r in rows] == [(3, ["strasse", "strasse", "k"], "strasse"), (None, None, None), (0, [], None)]
    assert [p.findall(r) for r in ("die straße und STRASSE, \u212a", "")] == [["strasse", "strasse", "k"], []]


def test_columns_find_what_texts_do(spark):
    r = random.Random(4)
    for _ in range(4):
        keys = {"".join(r.choices("ab[]^-&\\.*$é ~#", k=r.randint(1, 4))) for _ in range(12)}
        p = PatternSet.fromkeys(keys)
        texts = ["".join(r.choices("ab[]^-&\\.*$é ~#x", k=40)) for _ in range(20)]
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", p.findall_column(F.col("t")).alias("m"), p.count_column(F.col("t")).alias("n"))
        assert {x.t: (x.m, x.n) for x in df.collect()} == {t: (p.findall(t), len(p.findall(t))) for t in texts}


def test_orders_of_keys():
    p = PatternSet.fromkeys(["b", "B", "ab", "a", "A", "abc", "Z"])
    assert p.sort_keys() == ["A", "a", "ab", "abc", "B", "b", "Z"]
    assert p.sort_keys(ascending=False) == ["Z", "b", "B", "a", "ab", "abc", "A"]
    assert p.sort_keys(case_sensitive=False) == ["A", "B", "Z", "a", "ab", "abc", "b"]


def test_plain_expressions_find_the_same():
    r = random.Random(8)
    for _ in range(30):
        p = PatternSet.fromkeys({"".join(r.choices("abc.", k=r.randint(1, 4))) for _ in range(8)})
        plain, short = (re.compile(p.to_regex(simplify=s)) for s in (False, True))
        assert "[" not in plain.pattern
        for _ in range(20):
            text = "".join(r.choices("abc.x", k=15))
            assert plain.findall(text) == short.findall(text) == p.findall(text)


def test_tables_of_replacements_are_measured_whole(spark, monkeypatch):
    from gramloom.operators import patterns

    monkeypatch.setattr(patterns, "MAX_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        PatternSet.from_table(spark.createDataFrame([("a", "x" * 200)], "key string, replacement string"))
