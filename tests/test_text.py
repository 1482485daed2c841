"""Tokens, sentences, shingles and normal forms."""

import unicodedata

from pyspark.sql import functions as F

from gramloom.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_words(spark):
    assert one(spark, "O'reilly, isn’t x_1 ⅷ́é", X.words) == ["O", "reilly", "isn", "t", "x", "1", "ⅷ́é"]
    assert one(spark, "", X.words) == []
    assert one(spark, None, X.words) is None


def test_apostrophes(spark):
    merged = lambda t: X.token_texts(t, merge_apostrophe_word=True)
    assert one(spark, "O'reilly", merged) == ["O'reilly"]
    assert one(spark, "wasn’t", merged) == ["wasn’t"]
    assert one(spark, "wasn‘t", merged) == ["wasn", "‘", "t"]
    assert one(spark, "l'ensemble", merged) == ["l'ensemble"]
    assert one(spark, "‘test test’oops", merged) == ["‘", "test", " ", "test’oops"]
    assert one(spark, "a'b'c", merged) == ["a", "'", "b", "'", "c"]
    assert one(spark, "'a'b", merged) == ["'", "a", "'", "b"]
    assert one(spark, "a''b x'", merged) == ["a", "'", "'", "b", " ", "x", "'"]


def test_tokens(spark):
    got = one(spark, "a😀 b!⠀", X.tokens)
    assert [tuple(t) for t in got] == [("a", 0, "WORD"), ("😀", 1, "PUNCTUATION"), (" ", 2, "WHITESPACE"), ("b", 3, "WORD"), ("!", 4, "PUNCTUATION"), ("⠀", 5, "WHITESPACE")]
    assert [t.text for t in one(spark, "a b!", lambda t: X.tokens(t, words_only=True))] == ["a", "b"]
    assert one(spark, "", X.tokens) == []


def test_tokens_of_long_texts(spark):
    text = "word, " * 2000
    got = one(spark, text, X.tokens)
    assert "".join(t.text for t in got) == text and all(text[t.start_pos : t.start_pos + len(t.text)] == t.text for t in got)


def test_character_classes(spark):
    chars = [(c,) for c in "aé1_  ​\x00!…'´"]
    rows = spark.createDataFrame(chars, "c string").select("c", X.is_word_char(F.col("c")).alias("w"), X.is_text_char(F.col("c")).alias("t"), X.is_space_char(F.col("c")).alias("s"), X.is_punctuation_char(F.col("c")).alias("p")).collect()
    for r in rows:
        kind = unicodedata.category(r.c)
        assert r.w == (kind[0] in "LM") and r.t == (kind[0] in "LMN" or kind == "Co") and r.s == (r.c in X.SPACES)
        assert r.p == (r.c in X.UNPRINTABLE or kind[0] in "PS")


def test_sentences(spark):
    text = 'Hello there. He said "Go!" Now go (ok?) 192.168.1.1 yes... ok\n \nNew para. “Hi.” x'
    assert one(spark, text, X.sentence_split) == ["Hello there.", 'He said "Go!"', "Now go (ok?)", "192.168.1.1 yes...", "ok", "New para.", "“Hi.”", "x"]
    assert one(spark, "a.|b. c", lambda t: X.sentence_split(t, "|")) == ["a.", "b.", "c"]
    assert one(spark, "a.\nb", lambda t: X.sentence_split(t, False)) == ["a.", "b"]
    assert one(spark, "a b. c", X.sentence_split_tokens)[1][0].text == "c"


def test_shingles(spark):
    assert one(spark, "a b. c d e", X.word_n_grams) == [["a", "b"], ["c", "d"], ["d", "e"]]
    assert one(spark, "a b. c", lambda t: X.word_n_grams(t, 3, split_sentences=False)) == [["a", "b", "c"]]
    assert one(spark, "abcd", X.text_n_grams) == ["ab", "bc", "cd"]
    assert one(spark, "a", X.text_n_grams) == []


def test_normal_forms(spark):
    for text in ("ẞtraße ΣΑΣ İ ﬁ ǅ", "plain ASCII", "ΌΣΟΣ", ""):
        assert one(spark, text, X.casefold) == text.casefold()
    assert one(spark, "é ﬁ", X.normalize_nfc) == "é ﬁ"
    assert one(spark, "é ﬁ", X.normalize_nfkc) == "é fi"
    assert one(spark, "Éàñ ø", X.normalize_nfd_strip_marks) == "Ean ø"
    assert one(spark, None, X.normalize_nfc) is None
