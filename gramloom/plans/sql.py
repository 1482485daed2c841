"""DuckDB SQL for what the queries compute, built from a few pieces.

Sums of doubles are rounded to 9 places where they are made: DuckDB adds in the order in which its threads finish.
"""

from __future__ import annotations


def emd(x: str, y: str) -> str:
    """Least cost to match two sorted lists of positions."""
    return f"""list_last(list_reduce({x}, lambda prev, xi: list_reduce(range(1, len({y}) + 1), lambda cur, j:
      list_append(cur, least(abs(xi - {y}[j]) + prev[j], 1.0 + prev[j + 1], 1.0 + list_last(cur))), [prev[1] + 1.0]),
      list_transform(range(0, len({y}) + 1), lambda j: j::DOUBLE)))"""


def gram_rows(source: str, n: int, keep: str = "word", word: str = "word", pad: bool | None = None) -> str:
    """(keep, n, gram, first, pos) of a table with a column of words."""
    text = f"chr(2) || {word} || chr(3)" if (n > 1 if pad is None else pad) else word
    return f"""SELECT {keep}, {n} AS n, gram, min(i) + 1 AS first, list_sort(list(i / greatest(1, len(p) - {n}))) AS pos FROM (
      SELECT {keep}, p, i, substring(p, (i + 1)::INT, {n}) AS gram FROM (SELECT {keep}, {text} AS p FROM {source}) s, unnest(range(0, greatest(len(p) - {n} + 1, 0))) t(i)) GROUP BY ALL""".replace("GROUP BY ALL", f"GROUP BY {keep}, p, gram")


def pair_similarity(left: str, right: str, n: int = 2) -> str:
    """(l, r, sim) of all pairs of words that share a gram; both sources have one column, word."""
    return f"""SELECT a.word AS l, b.word AS r, round(sum(len(a.pos) + len(b.pos) - {emd("a.pos", "b.pos")}), 9) AS sim
      FROM ({gram_rows(left, n)}) a JOIN ({gram_rows(right, n)}) b ON a.gram = b.gram GROUP BY 1, 2"""


def lookup(vocab: str, queries: str, n_list: tuple[int, ...], k: int, filter_n: int = 3, dim: float = 1, normalize: bool = True, mode: str = "v6") -> str:
    """All queries scored against all words, without pruning. ``vocab`` has word, ``queries`` query, both folded."""
    v3 = mode == "v3"
    grams_v = " UNION ALL ".join(gram_rows("v", n, "word_id, word") for n in n_list)
    grams_q = " UNION ALL ".join(gram_rows("q", n, "query", "query") for n in n_list)
    count = lambda w: f"(len({w}) + CASE WHEN n > 1 THEN 3 - n ELSE 2 END)"
    total = count("query") if v3 else f"({count('query')} + {count('word')})"
    value = f"greatest(len(x), len(y)) - {emd('x', 'y')}" if v3 else f"len(x) + len(y) - {emd('x', 'y')}"
    weight = f"CASE WHEN {total} > 0 THEN 1.0 / {total} ELSE 0 END" if normalize or v3 else "1.0"
    cand = f"cand AS (SELECT DISTINCT query, word_id FROM ({gram_rows('q', filter_n, 'query', 'query')}) a JOIN ({gram_rows('v', filter_n, 'word_id, word')}) b ON a.gram = b.gram)," if filter_n and not v3 else ""
    semi = "SEMI JOIN cand USING (query, word_id)" if filter_n and not v3 else ""
    limit = {"v6": 2 * k, "v5": 2 * k, "v5b": k, "v3": k}[mode]
    sim2 = f"""coalesce((SELECT sum(len(a.pos) + len(b.pos) - {emd("a.pos", "b.pos")}) FROM g2q a JOIN g2v b ON a.gram = b.gram WHERE a.query = s.query AND b.word_id = s.word_id), 0){" / (len(s.query) + len(s.word) + 2)" if normalize or v3 else ""}"""
    final = "row_number() OVER (PARTITION BY query ORDER BY score DESC, sim2 DESC, hit, word_id)" if mode == "v6" else "rk"
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY word) - 1 AS word_id, word FROM ({vocab})), q AS ({queries}),
      gv AS ({grams_v}), gq AS ({grams_q}), g2v AS ({gram_rows("v", 2, "word_id, word")}), g2q AS ({gram_rows("q", 2, "query", "query")}), {cand}
      j AS (SELECT gq.query, gv.word_id, gv.word, gq.n, gq.first, gq.pos AS x, gv.pos AS y FROM gq JOIN gv ON gq.n = gv.n AND gq.gram = gv.gram),
      per AS (SELECT query, word_id, word, n, sum(({value}) * ({weight})) AS s, min(first) AS first FROM j {semi} GROUP BY ALL),
      scored AS (SELECT query, word_id, word, round(pow(sum(pow(greatest(s, 0), {dim})) / {len(n_list)}, 1.0 / {dim}), 9) AS score, min(n * 100000 + first) AS hit FROM per GROUP BY query, word_id, word),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit, word_id) AS rk FROM scored),
      best AS (SELECT s.*, round({sim2}, 9) AS sim2 FROM ranked s WHERE rk <= {limit}),
      done AS (SELECT *, {final} AS rank FROM best)
      SELECT query, rank::INT AS rank, word, round(score, 6) AS score, round(sim2, 6) AS sim2 FROM done WHERE rank <= {k if mode == "v6" else limit}"""


def word_set(vocab: str, queries: str, n_list: tuple[int, ...], filter_n: int, k: int, least: float = 0.0) -> str:
    grams_v = " UNION ALL ".join(gram_rows("v", n, "word_id, word", pad=True) for n in n_list)
    grams_q = " UNION ALL ".join(gram_rows("q", n, "query", "query", pad=True) for n in n_list)
    count = lambda w: " + ".join(f"greatest(len({w}) + 3 - {n}, 0)" for n in n_list)
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY word) - 1 AS word_id, word FROM ({vocab})), q AS ({queries}), gv AS ({grams_v}), gq AS ({grams_q}),
      j AS (SELECT gq.query, gv.word_id, gv.word, gq.n, gq.pos AS x, gv.pos AS y FROM gq JOIN gv ON gq.n = gv.n AND gq.gram = gv.gram),
      s AS (SELECT query, word_id, word, round(greatest(0, least(1, sum(len(x) + len(y) - {emd("x", "y")}) / ({count("query")} + {count("word")}))), 9) AS similarity FROM j GROUP BY query, word_id, word HAVING bool_or(n = {filter_n})),
      r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, word_id) AS rank FROM s WHERE similarity >= {least})
      SELECT query, rank::INT AS rank, word, round(similarity, 6) AS similarity FROM r WHERE rank <= {k}"""


def extended(hyp: str, ref: str) -> str:
    """Extended edit distance; the state holds the row and the visits, both with a place before the first letter."""
    line = f"""list_reduce(range(1, len(h) + 1), lambda c, i: list_append(c, least(list_last(c) + 0.2, s[1][i] + CASE WHEN substring(h, i::INT, 1) = x THEN 0.0 ELSE 1.0 END, s[1][i + 1] + 1.0)), [s[1][1] + 1.0])"""
    first = "list_position(list_transform(r, lambda v: round(v, 9)), list_min(list_transform(r, lambda v: round(v, 9))))"
    step = f"""list_transform([{line}], lambda r: list_transform([{first}], lambda a: [
      CASE WHEN x = ' ' THEN list_transform(r, lambda v: least(v, 2.0 + r[a])) ELSE r END, list_transform(s[2], lambda v, i: v + CASE WHEN i = a THEN 1.0 ELSE 0.0 END)])[1])[1]"""
    start = "[list_transform(range(0, len(h) + 1), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE 1.0 END), list_transform(range(0, len(h) + 1), lambda i: 0.0)]"
    return f"""SELECT {hyp}, {ref}, least(1.0, (list_last(e[1]) + cover) / (len(g) + cover)) AS distance FROM (SELECT *, 0.3 * list_sum(list_transform(e[2], lambda v: abs(v - 1))) AS cover FROM (
      SELECT *, list_reduce(list_transform(range(1, len(g) + 1), lambda j: [[ascii(substring(g, j::INT, 1))::DOUBLE]]), lambda s, y: list_transform([chr(y[1][1]::INT)], lambda x: {step})[1], {start}) AS e
      FROM (SELECT *, ' ' || {hyp} || ' ' AS h, ' ' || {ref} || ' ' AS g FROM pairs)))"""


def osa(a: str, b: str, swap: int = 1) -> str:
    """Optimal string alignment; the state holds the last two rows."""
    return f"""list_last(list_reduce(range(1, length({a}) + 1), lambda s, i: [s[2],
      list_reduce(range(1, length({b}) + 1), lambda c, j: list_append(c, least(s[2][j + 1] + 1, list_last(c) + 1,
        s[2][j] + (substring({a}, i::INT, 1) <> substring({b}, j::INT, 1))::BIGINT,
        CASE WHEN i > 1 AND j > 1 AND substring({a}, i::INT, 1) = substring({b}, (j - 1)::INT, 1) AND substring({a}, (i - 1)::INT, 1) = substring({b}, j::INT, 1)
             THEN s[1][j - 1] + {swap} ELSE 99999 END)), [i])],
      [range(0, length({b}) + 1), range(0, length({b}) + 1)])[2])"""
