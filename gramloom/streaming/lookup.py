"""Streams against a dictionary: each micro-batch is looked up, or added to the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.lookup import GramIndex
from ..operators.patterns import PatternSet


def lookup_stream(queries: DataFrame, index: GramIndex, sink: Callable[[DataFrame, int], None], word: str = "query", **options: object) -> DataStreamWriter:
    """A writer that looks up the words of each micro-batch and hands (results, batch number) to ``sink``."""
    return queries.writeStream.foreachBatch(lambda batch, number: sink(index.lookup(batch, word, **options), number))


def translate_stream(texts: DataFrame, patterns: PatternSet, text: str = "value") -> DataFrame:
    """A stream with all patterns replaced in a column; it has no state."""
    from pyspark.sql import functions as F

    return texts.withColumn(text, patterns.translate_column(F.col(text)))


class GrowingIndex:
    """An index that a stream of words adds to; a batch that is repeated adds nothing, as its words are known.

    Every ``compact_every`` batches its tables are written anew as one, so that they don't grow into long unions.
    """

    def __init__(self, index: GramIndex, compact_every: int = 16) -> None:
        self.index, self.compact_every, self._batches = index, compact_every, 0

    def add_stream(self, words: DataFrame, word: str = "word") -> DataStreamWriter:
        def add(batch: DataFrame, _: int) -> None:
            self.index = self.index.add(batch, word)
            self._batches += 1
            if self._batches % self.compact_every == 0:
                self.index = self.index.compact()

        return words.writeStream.foreachBatch(add)
