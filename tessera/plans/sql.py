"""Pieces of SQL that several oracles share."""

from ..functions.text import KEYWORD_STOPWORDS, SEARCH_STOPWORDS


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TOKENS = f"""list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9_\\-.]+'),
  lambda t: NOT list_contains({quoted(SEARCH_STOPWORDS)}, t) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$')) AND NOT regexp_matches(t, '^[._-]+$'))"""

KEYWORDS = f"""list_filter(string_split_regex(lower(coalesce({{0}}, '')), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'),
  lambda w: regexp_matches(w, '^[a-z_][a-z0-9_]{{{{3,}}}}$') AND NOT list_contains({quoted(KEYWORD_STOPWORDS)}, w))"""


def tokens(column: str) -> str:
    return TOKENS.format(column)


def keywords(column: str) -> str:
    return KEYWORDS.format(column)


BM25 = f"""
tok AS (SELECT doc_id AS id, {tokens('text')} AS tokens FROM documents),
live AS (SELECT * FROM tok WHERE len(tokens) > 0),
postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM live) GROUP BY id, term),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM live),
lengths AS (SELECT id, len(tokens) AS dl FROM live),
raw AS (SELECT term, count(*) AS df, ln(max(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, stats GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT query_id, p.id, sum(times * idf * (tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * dl / avgdl)))) AS score
  FROM postings p JOIN terms USING (term) JOIN idf USING (term) JOIN lengths l ON l.id = p.id, stats GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= {{k}} AND score > 0)"""


def bm25(k: int) -> str:
    return BM25.replace("{k}", str(k))


#: Cosine of e.embedding and q.embedding.
COSINE = "coalesce(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 0)"
SQUARED = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
