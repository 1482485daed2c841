"""Word lists, lines and replaced files, by Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import PatternSet


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): the words of text files, parted by white space; repeated ones stay."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).filter("word <> ''")


def read_first_fields(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(word): the first field of each line."""
    return spark.read.text(path).select(F.trim(F.split("value", "\\Q" + sep + "\\E", 2)[0]).alias("word")).filter("word <> ''")


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """(value, i, char): the characters of each line."""
    return spark.read.text(path).select("value", F.posexplode(F.split("value", "")).alias("i", "char"))


def write_words(words: DataFrame, path: str, word: str = "word", mode: str = "error") -> None:
    """A word a line."""
    words.select(word).write.mode(mode).text(path)


def replace_files(spark: SparkSession, source: str, target: str, patterns: PatternSet, overwrite: bool = False) -> None:
    """Text files with all patterns replaced, line by line; an existing target stays unless ``overwrite``.

    The commit protocol of Spark's writer makes the target appear as a whole.
    """
    lines = spark.read.text(source)
    lines.select(patterns.translate_column(F.col("value")).alias("value")).write.mode("overwrite" if overwrite else "ignore").text(target)
