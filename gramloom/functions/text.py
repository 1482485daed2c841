"""Tokens, sentences and shingles as regular expressions of the JVM; case folding and Unicode forms."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import text_grams, windows

# The characters that count as white space, as closing punctuation, as apostrophes, and as
# quotes and brackets that may follow a sentence's end.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    "\x1c\x1d\x1e\x1f\u180e\u200b\u200c\u200d\u2060\ufeff\u2800"
)
CLOSING = "!.:;?\xa1\xbf\u037e\u0589\u06d4\u2026\u203c\u203d\u2047\u2048\u2049\u3002\ufe12\ufe14\ufe15\ufe16\ufe52\ufe54\ufe55\ufe56\ufe57\uff01\uff0e\uff1a\uff1b\uff1f\uff61"
APOSTROPHES = "'\u2019\uff07"
QUOTES = "\"\uff02)\uff09>\uff1e]\uff3d}\uff5d\u201d"
UNPRINTABLE = "".join(map(chr, [*range(0, 9), *range(14, 28), 127, 0xFFEF, 0xFFFD]))
#: What str.strip() removes.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def char_class(chars: str) -> str:
    """A class of the given characters, by code point."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


WORD_CLASS = r"[\p{L}\p{M}\p{N}\p{Co}]"
WORD = f"{WORD_CLASS}+"
_APOSTROPHE = char_class(APOSTROPHES)
#: Two words with one apostrophe between, where neither side goes on with another apostrophe.
MERGED = f"(?<!{WORD_CLASS}|{_APOSTROPHE}){WORD}{_APOSTROPHE}{WORD}(?!{WORD_CLASS}|{_APOSTROPHE})"
#: Characters that most texts consist of, none of which ends a sentence; one look-up tells them.
_PLAIN = "[" + "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123), *range(192, 256)])) + " ,'" + "]"
_CLOSING, _QUOTES, _SPACES = map(char_class, (CLOSING, QUOTES, SPACES))
#: Up to the first closing character that white space follows, in possessive steps that are never taken back; or all that is left.
SENTENCE = rf"(?:{_PLAIN}++|[^{_CLOSING[1:]}|{_CLOSING}(?!{_QUOTES}*+{_SPACES}))*+{_CLOSING}{_QUOTES}*+{_SPACES}|[\s\S]+"


def is_word_char(char: Column) -> Column:
    return F.regexp_like(char, F.lit(r"^[\p{L}\p{M}]$"))


def is_text_char(char: Column) -> Column:
    return F.regexp_like(char, F.lit(f"^{WORD_CLASS}$"))


def is_space_char(char: Column) -> Column:
    return F.regexp_like(char, F.lit(f"^{char_class(SPACES)}$"))


def is_punctuation_char(char: Column) -> Column:
    return F.regexp_like(char, F.lit(rf"^(?:[\p{{P}}\p{{S}}]|{char_class(UNPRINTABLE + CLOSING)})$"))


def words(text: Column, merge_apostrophe_word: bool = False) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(text, F.lit(f"({MERGED}|{WORD})" if merge_apostrophe_word else f"({WORD})"))


def token_texts(text: Column, merge_apostrophe_word: bool = False) -> Column:
    """All tokens: words, and every other character by itself."""
    return F.regexp_extract_all(text, F.lit((f"({MERGED}|" if merge_apostrophe_word else "(") + rf"{WORD}|[\s\S])"))


def category(token: Column) -> Column:
    return F.when(F.regexp_like(token, F.lit(f"^{WORD_CLASS}")), F.lit("WORD")).when(is_space_char(token), F.lit("WHITESPACE")).otherwise(F.lit("PUNCTUATION"))


def tokens(text: Column, words_only: bool = False, merge_apostrophe_word: bool = False) -> Column:
    """Array of (text, start_pos, category).

    Starts come from a running sum over the tokens' lengths, kept beside the tokens, so the work is linear
    in blocks of 256 tokens.
    """

    def placed(all_: Column) -> Column:
        sizes = F.transform(all_, F.length)
        sums = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / 256).cast("int")), lambda b: F.struct(F.slice(all_, b * 256 + 1, 256).alias("t"), sums(F.slice(sizes, b * 256 + 1, 256)).alias("n")))

        def within(base: Column, block: Column) -> Column:
            init = F.struct(base.alias("at"), F.array().cast("array<struct<text:string,start_pos:int,category:string>>").alias("out"))
            step = lambda s, t: F.struct((s["at"] + F.length(t)).alias("at"), F.concat(s["out"], F.array(F.struct(t.alias("text"), s["at"].alias("start_pos"), category(t).alias("category")))).alias("out"))
            return F.aggregate(block["t"], init, step, lambda s: s["out"])

        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + b["n"])))
        return F.when(F.size(all_) > 0, F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: within(s, b)))).otherwise(F.array().cast("array<struct<text:string,start_pos:int,category:string>>"))

    out = F.transform(F.array(token_texts(text, merge_apostrophe_word)), placed)[0]
    return F.filter(out, lambda t: t["category"] == "WORD") if words_only else out


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(STRIPPED))


def paragraphs(text: Column, split_newline: bool | str = True) -> Column:
    if split_newline is True:
        split_newline = "\n"
    parts = F.split(text, "\\Q" + split_newline + "\\E", -1) if split_newline else F.array(text)
    return F.transform(parts, strip)


def _raw_sentences(text: Column, split_newline: bool | str) -> Column:
    return F.flatten(F.transform(paragraphs(text, split_newline), lambda p: F.regexp_extract_all(p, F.lit(f"({SENTENCE})"))))


def sentence_split(text: Column, split_newline: bool | str = True) -> Column:
    """Sentences: they end where white space follows closing punctuation, with quotes or brackets between at most."""
    return F.filter(F.transform(_raw_sentences(text, split_newline), strip), lambda s: s != "")


def sentence_split_tokens(text: Column, split_newline: bool | str = True, merge_apostrophe_word: bool = False) -> Column:
    """The tokens of each sentence, starts counted within the sentence's own text."""
    return F.transform(_raw_sentences(text, split_newline), lambda s: tokens(s, merge_apostrophe_word=merge_apostrophe_word))


def word_n_grams(text: Column, n: int = 2, split_sentences: bool = True, merge_apostrophe_word: bool = False) -> Column:
    """Runs of n words, by default within sentences."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    if not split_sentences:
        return F.transform(F.array(words(text, merge_apostrophe_word)), lambda w: windows(w, n))[0]
    return F.flatten(F.transform(_raw_sentences(text, True), lambda s: F.transform(F.array(words(s, merge_apostrophe_word)), lambda w: windows(w, n))[0]))


text_n_grams = text_grams


@lru_cache(maxsize=1)
def _special_folds() -> dict[str, str]:
    """Characters whose case folding differs from their lower case, from Python's Unicode tables; both sigmas depend on the place in lower case."""
    found = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and c.casefold() != c.lower()}
    return found | {"Σ": "σ", "ς": "σ", "İ": "İ".casefold()}


def casefold(text: Column) -> Column:
    """Full case folding: lower case, but character by character where a text holds special characters."""
    special = _special_folds()
    pairs = F.create_map(*(F.lit(x) for kv in special.items() for x in kv))
    slow = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), F.lower(c))), "")
    return F.when(text.rlike(char_class("".join(special))), slow).otherwise(F.lower(text))


def _normalizer(change: Callable[[str], str]):
    """An Arrow UDF of a string function; plain ASCII is its own form in all Unicode forms."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else change(x))

    return run


def normalize_nfc(text: Column) -> Column:
    return _normalizer(lambda x: unicodedata.normalize("NFC", x))(text)


def normalize_nfkc(text: Column) -> Column:
    return _normalizer(lambda x: unicodedata.normalize("NFKC", x))(text)


def normalize_nfd_strip_marks(text: Column) -> Column:
    """Decomposed, without marks."""
    return F.regexp_replace(_normalizer(lambda x: unicodedata.normalize("NFD", x))(text), r"\p{M}", "")
