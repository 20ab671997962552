"""Pieces of DuckDB SQL for the oracles, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions.text import GENERIC_SEGMENTS, STOPWORDS


def strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def toks(x: str, keep: bool = False) -> str:
    stop = "" if keep else f" AND t NOT IN ({strings(STOPWORDS)})"
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1{stop})"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


GENERIC = strings(GENERIC_SEGMENTS)
TYPES = "['standard', 'economy', 'medium', 'promo', 'large', 'small']"

#: Documents and benchmark passages: tokens, lengths, idf, queries.
BASE = f"""
tok AS (SELECT doc_id, unnest({toks("coalesce(text, '')")}) AS term FROM documents),
post AS (SELECT term, doc_id, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, len({toks("coalesce(text, '')")})::DOUBLE AS len FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM lens),
idf AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, stats GROUP BY term, n),
qt AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({toks("text")}) AS term FROM benchmark) GROUP BY ALL)"""

BM25 = """w * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.4::DOUBLE + 0.6::DOUBLE * len / mean))"""
LEXICAL = f"""
lexical AS (SELECT query_id, doc_id, round(sum({BM25}), 6) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL)"""

PHRASE = f"""
phrase AS (SELECT item_id AS query_id, {norm("text")} AS phrase FROM benchmark),
rarity AS (SELECT query_id, phrase, least(greatest(avg(coalesce(idf, 0)) / 10, 0.05), 1.0)::DOUBLE AS rarity
  FROM (SELECT query_id, phrase, unnest({toks("phrase")}) AS term FROM phrase WHERE length(phrase) >= 8) LEFT JOIN idf USING (term) GROUP BY ALL),
body AS (SELECT doc_id, {norm("coalesce(text, '')")} AS body FROM documents),
evidence AS (SELECT query_id, doc_id, round(sum(rarity), 6) AS score FROM body JOIN rarity ON contains(body, phrase) GROUP BY ALL)"""

#: Parts as products.
PRODUCTS = f"""
prod AS (SELECT p_partkey AS doc_id, p_name AS title, p_brand AS store, p_type || ' ' || p_brand AS categories, p_type, p_brand,
  {norm("p_type || ' ' || p_brand")} AS label, p_retailprice AS price FROM part),
said AS (SELECT doc_id AS query_id, CASE doc_id % 3
  WHEN 0 THEN 'I''m looking for ' || p_type || ' ' || p_brand || '. A key requirement is: ' || title || '.'
  WHEN 1 THEN 'Hey, any ' || p_type || ' ' || p_brand || ' with a ' || title || '?'
  ELSE 'Some ' || lower(p_type) || ' brand things, really ' || title END AS message FROM prod),
segs AS (SELECT DISTINCT doc_id, {norm("s")} AS segment FROM (SELECT doc_id, unnest([p_type, p_brand]) AS s FROM prod)),
bucket AS (SELECT label, count(*) AS n_docs, min(doc_id) AS first_doc FROM prod GROUP BY label)"""

#: User turns with the label that each names, as 1, 2, ... within a session.
TURNS = f"""
named AS (SELECT conv_id AS session, turn AS raw_turn, coalesce(text, '') AS text, (conv_id * 7 + turn) % 5 = 0 AS revokes,
  {TYPES}[(conv_id % 6 + 1)::INT] || ' brand#' || (conv_id % 25 + 1)::VARCHAR AS named FROM conversations WHERE role = 'user'),
turns AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY raw_turn) AS turn,
  CASE WHEN raw_turn <= 1 THEN 'I''m looking for ' || named || '. ' || text WHEN revokes THEN 'Actually, change to ' || named || '; ' || text ELSE text END AS message,
  CASE WHEN raw_turn <= 1 OR revokes THEN named END AS found FROM named)"""
