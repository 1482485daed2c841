"""Secret scan in DataFrame functions: fixed patterns, and sliding-window entropy over candidate strings.

Base spans are the leftmost non-overlapping matches of three patterns (kinds ``assign``, ``access`` and
``hex``); matches that fail their length rule are dropped after matching. The method adds spans of the
kinds ``entropy_hex`` and ``entropy_base64``: a candidate string is a run of at least ``window``
characters of the base64 alphabets, of class hex if it has hex digits only. A window of ``window``
characters slides over it; the symbols' counts and the sum of c * log2(c) are updated for the symbol that
enters and the one that leaves, which gives the window's Shannon entropy, log2(w) - sum / w. Windows at
or above the class's threshold are flagged, overlapping ones merged. A candidate that matches a pattern
of the allow-list is suppressed, and so is an added span within a base span. The allow-list never
touches base spans.

All is row by row in JVM expressions: nothing is shuffled, no source or group of copies can be hot, and
a lost executor costs its rows only. Defined results: null text is empty text and has no spans; repeated
rows give repeated results; an empty table an empty one; extra columns are kept, but columns named like
the result (``names``) are replaced. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, unused, utf8

#: Fixed values of the contract, in its order: kind, pattern, and the number of characters that group 1 must have.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"((?<![0-9a-f])[0-9a-f]{24,})", 24),
)
#: A candidate's window; matches that are gathered at a time.
WINDOW, SPANS = 20, 128
#: Bits a symbol from which a window of a class is flagged; 20 symbols have 4.32 at most.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 4.0}
#: Suppressed candidates: plain words and paths without digits, runs of one symbol, ordered alphabets, placeholders.
ALLOW = (
    r"^[^0-9]*$",
    r"(.)\1{7}",
    r"(?i)abcdefgh|hijklmno|opqrstuv|01234567|12345678|98765432|qwertyui",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem",
)
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(text: Column, found: Column, keep, make) -> Column:
    """Spans of a pattern's matches from the texts between them: ``found`` has the matches, ``keep`` the pattern."""
    gaps = F.split(text, keep, -1)
    begin = lambda pos: F.struct(pos.alias("pos"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        return F.struct((start + F.length(x["m"]["all"])).alias("pos"), F.concat(acc["out"], make(start, x["m"])).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        # an array grows by copying, so the matches of a block are gathered apart
        done = F.transform(F.array(F.aggregate(own, begin(acc["pos"]), step)), lambda b: F.struct(b["pos"].alias("pos"), F.concat(acc["out"], b["out"]).alias("out")))
        return done[0]

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / SPANS).cast("int")), lambda b: F.slice(p, b * SPANS + 1, SPANS))
    placed = F.transform(F.array(pairs), lambda p: F.aggregate(blocks(p), begin(F.lit(0)), block, lambda a: a["out"]))[0]
    return F.when(F.size(found) > 0, placed).otherwise(_none())


def _span(start: Column, rank: int, kind: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), kind.alias("kind"), end.cast("int").alias("end"))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def window_flags(candidate: Column, window: int, threshold: Column) -> Column:
    """Merged (start, end) of the windows of ``candidate`` whose entropy reaches ``threshold``, by incremental counts."""
    chars = F.split(candidate, "")
    symbols = F.array_distinct(chars)
    codes = F.transform(chars, lambda c: F.array_position(symbols, c).cast("int"))
    bits = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    init = F.struct(
        F.transform(symbols, lambda _: F.lit(0)).alias("count"),
        F.lit(0.0).alias("sum"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def step(acc: Column, i: Column) -> Column:
        come = F.element_at(acc["codes"], i)
        gone = F.when(i > window, F.element_at(acc["codes"], i - window)).otherwise(F.lit(0))
        c_in = F.element_at(acc["count"], come)
        same = come == gone
        c_out = F.when(gone > 0, F.element_at(acc["count"], F.greatest(gone, F.lit(1)))).otherwise(F.lit(0))
        total = F.when(same, acc["sum"]).otherwise(acc["sum"] + bits(c_in + 1) - bits(c_in) + F.when(gone > 0, bits(c_out - 1) - bits(c_out)).otherwise(F.lit(0.0)))
        count = F.when(same, acc["count"]).otherwise(F.transform(acc["count"], lambda c, k: c + F.when(k + 1 == come, 1).otherwise(0) - F.when(k + 1 == gone, 1).otherwise(0)))
        entropy = F.lit(math.log2(window)) - total / window
        last = F.element_at(acc["out"], -1)
        hit = F.struct((i - window).cast("int").alias("start"), i.cast("int").alias("end"))
        merged = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), i.cast("int").alias("end"))))
        flagged = (i >= window) & (entropy >= threshold - 1e-9)
        out = F.when(~flagged, acc["out"]).when((F.size(acc["out"]) > 0) & (F.try_element_at(acc["out"], F.lit(-1))["end"] >= i - window), merged).otherwise(F.concat(acc["out"], F.array(hit)))
        return F.struct(acc["codes"].alias("codes"), count.alias("count"), total.alias("sum"), out.alias("out"))

    full = F.struct(codes.alias("codes"), init["count"].alias("count"), init["sum"].alias("sum"), init["out"].alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), full, step, lambda a: a["out"])


def find_secrets(df: DataFrame, text_col: str = "text", window: int = WINDOW, thresholds: dict[str, float] | None = None, allow: Sequence[str] = ALLOW, names: Sequence[str] = ("base_spans", "spans")) -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (or ``names``): arrays of (start, rank, kind, end) by start, then kind as listed."""
    base_, all_ = names
    limits = THRESHOLDS | (thresholds or {})
    t, found_, added, *matches = unused(df, "_text", "_found", "_added", *(f"_m{i}" for i in range(len(BASE))))
    out, text, parts = df.withColumn(t, utf8(F.col(text_col))), F.col(t), []
    for rank, (kind, pattern, least) in enumerate(BASE):
        found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda a, g: F.struct(a.alias("all"), g.alias("group")))
        out = out.withColumn(matches[rank], F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<all:string,group:string>>")))
        parts.append(_spans(text, F.col(matches[rank]), pattern, _base_span(rank, kind, least)))
    run = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{window},}}={{0,2}}"
    allowed = lambda c: F.exists(F.array(*map(F.lit, allow)), lambda p: F.regexp_like(c, p)) if allow else F.lit(False)
    strings = F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), lambda c: F.struct(c.alias("all"), F.when(allowed(c), _none()).otherwise(_flags(c, window, limits)).alias("group")))
    out = out.withColumn(found_, F.when(text.rlike(run), strings).otherwise(F.array().cast(f"array<struct<all:string,group:array<{SPAN}>>>")))
    shifted = lambda start, m: F.transform(m["group"], lambda s: _span(start + s["start"], 8, s["kind"], start + s["end"]))
    out = out.withColumn(added, _spans(text, F.col(found_), run, shifted))
    out = out.withColumn(base_, F.array_sort(F.concat(*parts)))
    inside = lambda s: F.exists(F.col(base_), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    out = out.withColumn(all_, F.array_sort(F.concat(F.col(base_), F.filter(F.col(added), lambda s: ~inside(s)))))
    return out.drop(t, found_, added, *matches)


def _base_span(rank: int, kind: str, least: int):
    return lambda start, m: F.when(F.length(m["group"]) >= least, F.array(_span(start, rank, F.lit(kind), start + F.length(m["all"])))).otherwise(_none())


def _flags(c: Column, window: int, limits: dict[str, float]) -> Column:
    body = F.rtrim(c, F.lit("="))
    is_hex = F.regexp_like(body, F.lit("^[0-9a-fA-F]+$"))
    kind = F.when(is_hex, F.lit("entropy_hex")).otherwise(F.lit("entropy_base64"))
    limit = F.when(is_hex, F.lit(limits["entropy_hex"])).otherwise(F.lit(limits["entropy_base64"]))
    return F.transform(window_flags(body, window, limit), lambda s: _span(s["start"], 8, kind, s["end"]))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", spans: str = "spans") -> DataFrame:
    """``text_col`` with each secret of the column ``spans`` replaced by ``mark``; overlapping spans give one mark."""
    text = F.col(text_col)
    init = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    # length + 1 is past the end, so the substring after the last span may be empty
    clean = F.aggregate(F.col(spans), init, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every text of ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
