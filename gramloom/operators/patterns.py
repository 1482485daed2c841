"""Many patterns at once: search, replace and regular expressions for a map of keys to replacements.

A ``PatternSet`` is a value: changes give a new one. Its map goes to the executors by broadcast, behind a
check of its size (``MAX_BYTES``); a larger dictionary has to be split by its keys' first characters.
Up to ``MAX_REGEX_KEYS`` keys of characters are searched by a regular expression, in the JVM where only matches
count; other text columns are searched in Arrow batches. Keys are sequences of characters or, with a tokenizer, of
tokens. Without case, keys and texts are case-folded, and the places of matches are those of the folded text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefold

MAX_BYTES, MAX_REGEX_KEYS = 256 << 20, 1000
#: Quotes and primes that an ASCII quote may stand for, with that quote.
FUZZY_QUOTES = {"‵": "'", "′": "'", "‘": "'", "’": "'", "`": "'", "´": "'", "”": '"', "“": '"', "〝": '"', "〞": '"'}


class Match:
    """A key found at tokens start .. end - 1 (characters, without a tokenizer); it answers like a match of a regular expression without groups."""

    __slots__ = ("_span", "_text")

    def __init__(self, start: int, end: int, match: str) -> None:
        self._span, self._text = (start, end), match

    def span(self, group: int = 0) -> tuple[int, int]:
        if group:
            raise IndexError("no such group")
        return self._span

    def start(self, group: int = 0) -> int:
        return self.span(group)[0]

    def end(self, group: int = 0) -> int:
        return self.span(group)[1]

    def group(self, group: int = 0) -> str:
        self.span(group)
        return self._text

    __getitem__ = group

    @property
    def str(self) -> str:
        return self._text

    @property
    def regs(self) -> tuple[tuple[int, int]]:
        return (self._span,)

    def __len__(self) -> int:
        return self._span[1] - self._span[0]

    def __str__(self) -> str:
        return self._text

    def __repr__(self) -> str:
        return f"Match{(*self._span, self._text)}"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Match) and (self._span, self._text) == (other._span, other._text)

    def __hash__(self) -> int:
        return hash((self._span, self._text))


class _Automaton:
    """All keys as paths of one table of moves; ``ends`` has what a path's end stands for."""

    def __init__(self, keys: Iterable[tuple[tuple, Any]]) -> None:
        self.moves: list[dict] = [{}]
        self.ends: dict[int, Any] = {}
        for key, value in keys:
            at = 0
            for token in key:
                nxt = self.moves[at].get(token)
                if nxt is None:
                    nxt = self.moves[at][token] = len(self.moves)
                    self.moves.append({})
                at = nxt
            self.ends[at] = value

    def from_(self, tokens: Sequence, start: int) -> Iterator[tuple[int, Any]]:
        """(end, value) of every key that starts here, shorter ones first."""
        at = 0
        for i in range(start, len(tokens)):
            at = self.moves[at].get(tokens[i])
            if at is None:
                return
            if at in self.ends:
                yield i + 1, self.ends[at]


class PatternSet:
    def __init__(self, replacements: Mapping[str, str] | Iterable[tuple[str, str]] = (), tokenizer: Callable[[str], Iterable[str]] | None = None, detokenizer: Callable[[Iterable[str]], str] = "".join, case_sensitive: bool = True) -> None:
        self.tokenizer, self.detokenizer, self.case_sensitive = tokenizer, detokenizer, case_sensitive
        items = replacements.items() if isinstance(replacements, Mapping) else replacements
        self._map = {self._fold(k): v for k, v in items}
        if "" in self._map:
            raise ValueError("a key must not be empty")
        self._built: _Automaton | None = None
        self._regex: re.Pattern | None = None

    @classmethod
    def fromkeys(cls, keys: Iterable[str], default: str = "", case_sensitive: bool = True) -> PatternSet:
        return cls(((k, default) for k in keys), case_sensitive=case_sensitive)

    from_keys = fromkeys

    @classmethod
    def from_table(cls, df: DataFrame, key: str = "key", replacement: str | None = "replacement", **options: Any) -> PatternSet:
        """From a table of bounded size; a key's last replacement in string order counts."""
        amount = F.coalesce(F.octet_length(key), F.lit(0)) + (F.coalesce(F.octet_length(replacement), F.lit(0)) if replacement else F.lit(0))
        size = df.agg(F.sum(amount.cast("long")).alias("b")).first()["b"] or 0
        if size > MAX_BYTES:
            raise ValueError(f"keys and replacements have {size} bytes; a broadcast dictionary may have {MAX_BYTES}")
        value = F.max(replacement) if replacement else F.lit("")
        return cls(((r[0], r[1]) for r in df.filter(F.col(key).isNotNull()).groupBy(key).agg(value.alias("v")).orderBy(key).toLocalIterator()), **options)

    def _fold(self, text: str) -> str:
        return text if self.case_sensitive else text.casefold()

    def _like(self, items: Mapping[str, str]) -> PatternSet:
        return PatternSet(items, self.tokenizer, self.detokenizer, self.case_sensitive)

    def _tokens(self, text: str) -> Sequence:
        text = self._fold(text)
        return list(self.tokenizer(text)) if self.tokenizer else text

    @property
    def _automaton(self) -> _Automaton:
        if self._built is None:
            self._built = _Automaton((tuple(self._tokens(k)), (k, v)) for k, v in self._map.items())
        return self._built

    @property
    def _expression(self) -> re.Pattern | None:
        """For few keys of characters, the regular expression that finds the same matches much faster."""
        if self._regex is None and not self.tokenizer and 0 < len(self._map) <= MAX_REGEX_KEYS:
            self._regex = re.compile(self.to_regex(fuzzy_quotes=False, fuzzy_spaces=False, fffd_any=False))
        return self._regex

    # the map

    def __len__(self) -> int:
        return len(self._map)

    def __contains__(self, key: str) -> bool:
        return self._fold(key) in self._map

    def _slice(self, part: slice) -> list[str]:
        names = sorted(self._map)
        lo = bisect_left(names, part.start) if part.start is not None else 0
        hi = bisect_left(names, part.stop) if part.stop is not None else len(names)
        return names[lo:hi][:: part.step]

    def __getitem__(self, key: str | slice) -> Any:
        """A key's replacement, or those of all keys with start <= key < stop, in order."""
        return [self._map[k] for k in self._slice(key)] if isinstance(key, slice) else self._map[self._fold(key)]

    def get(self, key: str, default: Any = None) -> Any:
        return self._map.get(self._fold(key), default)

    def items(self) -> list[tuple[str, str]]:
        return sorted(self._map.items())

    def keys(self) -> list[str]:
        return sorted(self._map)

    def sort_keys(self, ascending: bool = True, case_sensitive: bool = True) -> list[str]:
        """The keys by their tokens, each after its own beginnings: by case-folded tokens, then by the tokens; or, not ``case_sensitive``, by the tokens as they are."""
        tokens = {k: [*self._tokens(k)] for k in self._map}
        order = sorted({t for own in tokens.values() for t in own}, key=lambda t: (t.casefold(), t) if case_sensitive else ("", t))
        rank = {t: i if ascending else -i for i, t in enumerate(order)}
        return sorted(self._map, key=lambda k: [rank[t] for t in tokens[k]])

    def values(self) -> list[str]:
        return [v for _, v in self.items()]

    def set(self, key: str, value: str) -> PatternSet:
        return self.update({key: value})

    def setdefault(self, key: str, value: str) -> PatternSet:
        return self if key in self else self.set(key, value)

    def update(self, replacements: Mapping[str, str] | Iterable[tuple[str, str]]) -> PatternSet:
        more = replacements.items() if isinstance(replacements, Mapping) else replacements
        return self._like(self._map | {self._fold(k): v for k, v in more})

    def delete(self, key: str | slice) -> PatternSet:
        gone = set(self._slice(key)) if isinstance(key, slice) else {self._fold(key)}
        if not gone <= self._map.keys():
            raise KeyError(key)
        return self._like({k: v for k, v in self._map.items() if k not in gone})

    def pop(self, key: str | None = None) -> tuple[str, PatternSet]:
        """The value of a key (the first one by default), and the set without it."""
        if not self._map:
            raise KeyError(key)
        key = self.keys()[0] if key is None else self._fold(key)
        return self._map[key], self.delete(key)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.items(), "key string, replacement string")

    # search in one text

    def finditer(self, text: str, allow_overlapping: bool = False) -> Iterator[Match]:
        """Leftmost matches, the longest of each, without overlaps; or all, by end, then start."""
        tokens, machine = self._tokens(text), None if self._expression is not None and not allow_overlapping else self._automaton
        if allow_overlapping:
            found = [Match(i, e, k) for i in range(len(tokens)) for e, (k, _) in machine.from_(tokens, i)]
            yield from sorted(found, key=lambda m: m.span()[::-1])
            return
        if self._expression is not None:
            yield from (Match(*m.span(), m.group()) for m in self._expression.finditer(tokens))
            return
        at = 0
        while at < len(tokens):
            best = None
            for best in machine.from_(tokens, at):
                pass
            if best is None:
                at += 1
            else:
                yield Match(at, best[0], best[1][0])
                at = best[0]

    def search(self, text: str) -> Match | None:
        return next(self.finditer(text), None)

    def findall(self, text: str, allow_overlapping: bool = False) -> list[str]:
        return [m.str for m in self.finditer(text, allow_overlapping)]

    def findall_longest(self, text: str) -> list[str]:
        """Matches without overlaps of the greatest total length; of equal ones, those whose last match starts first."""
        all_ = self.finditer(text, allow_overlapping=True)
        # best choice up to each end where the total grows: ends, totals, last matches, and the choice before
        ends, totals, last, before = [0], [0], [None], [-1]
        for m in all_:
            k = len(ends) - 1
            while ends[k] > m.start():
                k -= 1
            total = totals[k] + len(m)
            if total > totals[-1]:
                if ends[-1] == m.end():
                    for a in (ends, totals, last, before):
                        a.pop()
                for a, v in zip((ends, totals, last, before), (m.end(), total, m, k)):
                    a.append(v)
        out, k = [], len(ends) - 1
        while k > 0:
            out.append(last[k].str)
            k = before[k]
        return out[::-1]

    def translate(self, text: str) -> str:
        """Replaces leftmost-longest matches; what is replaced is not searched again."""
        tokens = self._tokens(text)
        out, at = [], 0
        for m in self.finditer(text):
            out += [*tokens[at : m.start()], self._map[m.str]]
            at = m.end()
        return self.detokenizer([*out, *tokens[at:]])

    replace = translate
    find = find_first = search
    find_all, find_iter, find_longest = findall, finditer, findall_longest

    # columns

    def _udf(self, change: Callable[[PatternSet, str], Any], kind: str) -> Callable[[Column], Column]:
        size = sum(len(k) + len(str(v)) for k, v in self._map.items())
        if size > MAX_BYTES:
            raise ValueError(f"a broadcast dictionary may have {MAX_BYTES} bytes")
        shared = SparkSession.active().sparkContext.broadcast(self._like(self._map))

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            own = shared.value
            return s.map(lambda x: None if x is None else change(own, x))

        return run

    def translate_column(self, text: Column) -> Column:
        return self._udf(PatternSet.translate, "string")(text)

    def _jvm(self, text: Column) -> tuple[Column, Column] | None:
        """The text to search and the expression that finds any key, where the JVM can do it."""
        if self.tokenizer or not 0 < len(self._map) <= MAX_REGEX_KEYS:
            return None
        found = self.to_regex(fuzzy_quotes=False, fuzzy_spaces=False, fffd_any=False)
        return (text if self.case_sensitive else casefold(text)), F.lit(found)

    def findall_column(self, text: Column, allow_overlapping: bool = False) -> Column:
        if not allow_overlapping and (jvm := self._jvm(text)):
            return F.regexp_extract_all(*jvm, F.lit(0))
        return self._udf(lambda p, x: p.findall(x, allow_overlapping), "array<string>")(text)

    def search_column(self, text: Column) -> Column:
        """The first match's key, or null."""
        jvm = self._jvm(text)
        return F.regexp_substr(*jvm) if jvm else F.get(self.findall_column(text), 0)

    def findall_longest_column(self, text: Column) -> Column:
        return self._udf(PatternSet.findall_longest, "array<string>")(text)

    def match_table(self, df: DataFrame, text: str, *keep: str, allow_overlapping: bool = False) -> DataFrame:
        """(*keep, start, end, match): a row for each match."""
        spans = self._udf(lambda p, x: [{"start": m.start(), "end": m.end(), "match": m.str} for m in p.finditer(x, allow_overlapping)], "array<struct<start:int,end:int,match:string>>")
        return df.select(*keep, F.explode(spans(F.col(text))).alias("m")).select(*keep, "m.start", "m.end", "m.match")

    def count_column(self, text: Column) -> Column:
        """The number of leftmost-longest matches."""
        if not self._map:
            return F.lit(0)
        jvm = self._jvm(text)
        return F.regexp_count(*jvm) if jvm else F.size(self.findall_column(text))

    # regular expressions

    def to_regex(self, fuzzy_quotes: bool = True, fuzzy_spaces: bool = True, fffd_any: bool = True, simplify: bool = True, boundary: bool = False) -> str:
        """A regular expression that finds any key, the longest at each place; common prefixes are factored out.

        ``fuzzy_spaces``: a run of blanks matches any white space, more than one any amount. ``fuzzy_quotes``:
        typographic quotes and primes match the ASCII ones too. ``fffd_any``: U+FFFD matches any character.
        ``simplify``: single characters to choose from become a class, and groups of one item lose their brackets.
        """
        if self.tokenizer:
            raise ValueError("a regular expression needs keys of characters")

        def letter(c: str) -> str:
            if fuzzy_spaces and c.isspace():
                return r"\s"
            if fuzzy_quotes and c in FUZZY_QUOTES:
                return "[" + re.escape(c) + FUZZY_QUOTES[c] + "]"
            return "." if fffd_any and c == "�" else re.escape(c)

        def part(keys: list[str]) -> str:
            """An expression for sorted, distinct keys."""
            optional = keys[0] == ""
            heads: dict[str, list[str]] = {}
            for k in keys[optional:]:
                heads.setdefault(letter(k[0]), []).append(k[1:])
            arms = [h + part(sorted(set(rest))) for h, rest in heads.items()]
            if not arms:
                return ""
            single = len(arms) > 1 and all(len(a) == 1 or re.fullmatch(r"\\.", a) for a in arms) and "." not in arms
            single = single and simplify
            body = "[" + "".join(arms) + "]" if single else arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"
            if not optional:
                return body
            atom = simplify and (single or len(body) == 1 or re.fullmatch(r"\\.|\[[^\[\]]*\]", body) or (len(arms) > 1 and not single))
            return f"{body}?" if atom else f"(?:{body})?"

        out = part(sorted(self._map)) if self._map else "(?!)"
        out = re.sub(r"(?:\\s){2,}", lambda _: r"\s+", out) if fuzzy_spaces else out
        return rf"(?:\b{out}\b)" if boundary else f"(?:{out})"


def keys_to_regex(keys: Iterable[str], case_sensitive: bool = False, **options: bool) -> str:
    """The expression for words alone; without case, for use with a case-insensitive flag."""
    return PatternSet.fromkeys(keys, case_sensitive=case_sensitive).to_regex(**options)
