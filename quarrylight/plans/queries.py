"""One query per operator over the driver's tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import turns as T
from ..operators import category, contract, dense, fusion, index, metrics, pooled, profile, rankers, rerank, session
from ..operators.sizes import small
from ..ship import ship
from ..storage import spread, stored
from . import search, simulate
from . import sql as S
from .tables import documents, product_messages, products, questions, session_turns, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PART_FIELDS = {"title": 3.0, "categories": 2.0, "store": 1.5}
TEXT = {"text": 1.0}
K = 10


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# ---- text -------------------------------------------------------------------


@query(f"SELECT doc_id, len({S.toks('text', True)})::BIGINT AS n_all, len({S.toks('text')})::BIGINT AS n_kept FROM documents")
def tokenize_counts(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.size(X.tokens(t, True)).cast("long").alias("n_all"), F.size(X.tokens(t)).cast("long").alias("n_kept"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({S.toks('text', True)}) AS term FROM documents) WHERE term IN ({S.strings(X.STOPWORDS)}) GROUP BY term")
def stopword_filter(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"), True)).alias("term"))
    return words.filter(F.col("term").isin(X.STOPWORDS)).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256({S.norm('text')}) AS digest FROM documents")
def normalise_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.normalise(F.col("text")).cast("binary"), 256).alias("digest"))


@query("""SELECT p_partkey AS doc_id, 'brand ' || p_brand || ' type ' || p_type AS details, p_name || ' ' || p_type AS features,
  lower(p_name) || ' ' || lower(p_brand) || '  ' || lower(p_type) AS full_text,
  substr(p_name || ' | ' || p_type || ' | ' || p_brand, 1, 512) AS dense FROM part""")
def flatten_fields(spark, sf):
    p = table(spark, sf, "part")
    details = X.flatten_map(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type"))
    full = X.document_text(X.normalise(F.col("p_name")), X.normalise(F.col("p_brand")), F.lit(None).cast("string"), X.normalise(F.col("p_type")))
    dense = X.dense_text(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit(""))
    return p.select(F.col("p_partkey").alias("doc_id"), details.alias("details"), X.flatten_array(F.array("p_name", "p_type")).alias("features"), full.alias("full_text"), dense.alias("dense"))


@query("""SELECT p_partkey AS doc_id, list_filter([trim(p_type), trim(p_brand)], lambda s: s <> '')  AS path, p_type || ' ' || p_brand AS label,
  round(p_retailprice, 6) AS price FROM part""")
def category_path(spark, sf):
    p = table(spark, sf, "part")
    path = X.category_path(F.array(F.lit("Clothing"), F.concat_ws(" , ", "p_type", F.lit(""), "p_brand")))
    price = X.parse_price(F.concat(F.lit("$"), F.format_number("p_retailprice", 4)))
    return p.select(F.col("p_partkey").alias("doc_id"), path.alias("path"), X.coarse_label(path).alias("label"), F.round(price, 6).alias("price"))


@query("SELECT label, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, lower(lang || ' ' || source) AS label FROM documents) GROUP BY label")
def coarse_label(spark, sf):
    return category.buckets(category.doc_labels(documents(spark, sf)))


@query(f"WITH {S.PRODUCTS} SELECT label, n_docs, first_doc FROM bucket")
def label_buckets(spark, sf):
    return category.buckets(category.doc_labels(products(spark, sf)))


@query("""WITH v AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' -;,.' || chr(9) || chr(10)) AS c FROM documents)
SELECT doc_id, rtrim(substr(c, 1, 180)) AS constraint_text,
  CASE WHEN regexp_matches(lower(c), 'budget|(?:\\$|<=|under)\\s*[0-9]') THEN 'budget'
  WHEN regexp_matches(lower(c), 'cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric') THEN 'material'
  WHEN regexp_matches(lower(c), 'color|black|white|blue|red|pink|green') THEN 'color'
  WHEN regexp_matches(lower(c), 'size|sizing|width|wide|narrow') THEN 'size'
  WHEN regexp_matches(lower(c), 'department|style|fit|sleeve|neck') THEN 'style'
  WHEN regexp_matches(lower(c), 'hiking|running|gym|winter|outdoor|work') THEN 'use_case' ELSE 'feature' END AS kind FROM v""")
def constraint_kinds(spark, sf):
    raw = F.coalesce("text", F.lit(""))
    cleaned = X.clean_constraint(raw, 2**31 - 1)
    return table(spark, sf, "documents").select("doc_id", X.clean_constraint(raw, 180).alias("constraint_text"), X.classify_constraint(cleaned).alias("kind"))


@query(f"""WITH {S.PRODUCTS}
SELECT query_id, nullif(regexp_extract(lower(message), '\\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange)\\b', 1), '') AS color,
  nullif({S.norm("regexp_extract(message, '(?i)looking for\\s+(.+?)\\s*(?:[.,]|$)', 1)")}, '') AS said_label FROM said""")
def label_template(spark, sf):
    m = product_messages(spark, sf)
    return m.select("query_id", X.first_word_of(F.col("message"), X.COLORS).alias("color"), X.parse_label(F.col("message")).alias("said_label"))


# ---- index ------------------------------------------------------------------


@query(f"""WITH {S.PRODUCTS}, t AS (
  SELECT doc_id, unnest({S.toks("title")}) AS term, 3.0 AS w FROM prod UNION ALL SELECT doc_id, unnest({S.toks("categories")}), 2.0 FROM prod
  UNION ALL SELECT doc_id, unnest({S.toks("store")}), 1.5 FROM prod)
SELECT term, doc_id, sum(w)::DOUBLE AS tf FROM t GROUP BY ALL""")
def postings_tf(spark, sf):
    return index.postings(index.field_terms(products(spark, sf), PART_FIELDS))


@query(f"""WITH {S.PRODUCTS} SELECT doc_id, (3.0 * len({S.toks("title")}) + 2.0 * len({S.toks("categories")}) + 1.5 * len({S.toks("store")}))::DOUBLE AS len FROM prod""")
def doc_length(spark, sf):
    return products(spark, sf).select("doc_id", index.doc_length(PART_FIELDS).alias("len"))


@query(f"WITH {S.BASE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_idf(spark, sf):
    docs = documents(spark, sf)
    stats = index.corpus_stats(docs.select(index.doc_length(TEXT).alias("len")))
    return index.term_stats(index.postings(index.field_terms(docs, TEXT)), stats).select("term", "df", F.round("idf", 6).alias("idf"))


# ---- rankers ----------------------------------------------------------------


class Passages:
    """Passages as queries over documents, which are read once for all rankers; with ``same`` a query meets documents of its language only."""

    def __init__(self, spark, sf, weight=None, same=None):
        asked = questions(spark, sf)
        self.docs, self.same = documents(spark, sf), same
        terms = rankers.query_terms(asked, weight=weight)
        self.terms = stored(terms.join(languages(spark, sf), "query_id") if same else terms, "terms")
        self.corpus = index.corpus(self.docs, TEXT, self.terms, same)
        self.phrases = asked.select("query_id", F.col("text").alias("phrase"))

    def lexical(self, pool=None) -> DataFrame:
        return rankers.bm25(self.terms, self.corpus, pool, self.same)

    def evidence(self, pool=None) -> DataFrame:
        rarity = stored(rankers.phrase_rarity(self.phrases, self.corpus.idf), "rarity")
        return rankers.phrase_evidence(rarity, self.corpus, self.docs, pool=pool)

    def affinity(self, pool) -> DataFrame:
        text = self.docs.select("doc_id", F.lower(F.concat_ws(" ", "path")).alias("category_text"))
        return rankers.category_affinity(self.terms, self.corpus.idf, pool.join(text, "doc_id"))

    def fused(self, pool, evidence, points=None, k=None) -> DataFrame:
        """All rankers over each query's pool (query_id, doc_id, category_text), fused at each point of weights."""
        found = self.lexical().withColumn("ranker", F.lit("lexical")).unionByName(evidence.withColumn("ranker", F.lit("phrase")))
        return pooled.fused(rankers.category_affinity(self.terms, self.corpus.idf, pool), found, points, k)


def top(rows: DataFrame, k: int = K) -> DataFrame:
    return fusion.top_k(rows, k).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


TOP = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {rows}) WHERE rank <= 10"


@query(f"WITH {S.BASE}, {S.LEXICAL} {TOP.format(rows='lexical')}")
def bm25_topk(spark, sf):
    return top(Passages(spark, sf).lexical())


@query(f"WITH {S.BASE}, weighted AS (SELECT query_id, term, w * 0.8::DOUBLE ** (query_id % 3) AS w FROM qt), {S.LEXICAL.replace('FROM qt', 'FROM weighted')} {TOP.format(rows='lexical')}")
def bm25_weighted_terms(spark, sf):
    # A term said query_id mod 3 turns ago.
    weight = rankers.decayed(F.lit(1.0), F.col("query_id") % 3, F.lit(False), slot_decay=0.8)
    return top(Passages(spark, sf, weight).lexical())


def languages(spark, sf) -> DataFrame:
    """(query_id, lang): the language that a query's id picks."""
    return questions(spark, sf).select("query_id", F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("query_id") % 4 + 1).cast("int")).alias("lang"))


def language_pool(spark, sf) -> DataFrame:
    """Each query's pool: documents of the language that its id picks."""
    return documents(spark, sf).select("doc_id", "lang").join(small(languages(spark, sf)), "lang").select("query_id", "doc_id")


POOL = "pool AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON lang = ['de', 'en', 'es', 'fr'][(item_id % 4 + 1)::INT])"


@query(f"WITH {S.BASE}, {POOL}, {S.LEXICAL.replace('lexical AS', 'scored AS')}, pooled AS (SELECT s.* FROM scored s JOIN pool USING (query_id, doc_id)) {TOP.format(rows='pooled')}")
def bm25_pooled(spark, sf):
    return top(Passages(spark, sf).lexical(language_pool(spark, sf)))


AFFINITY = f"""affinity AS (SELECT query_id, p.doc_id, round(coalesce(sum(CASE WHEN contains(lower(lang || ' ' || source), term) THEN idf END), 0), 6) AS score
  FROM pool p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN (SELECT query_id, term, idf FROM qt JOIN idf USING (term)) k USING (query_id) GROUP BY ALL)"""


@query(f"WITH {S.BASE}, {POOL}, {AFFINITY} {TOP.format(rows='affinity')}")
def category_affinity(spark, sf):
    return top(Passages(spark, sf).affinity(language_pool(spark, sf)))


@query(f"WITH {S.BASE}, {S.PHRASE} SELECT * FROM evidence")
def phrase_evidence(spark, sf):
    return Passages(spark, sf).evidence()


@query(f"WITH {S.BASE}, {POOL}, {S.PHRASE} SELECT e.* FROM evidence e JOIN pool USING (query_id, doc_id)")
def phrase_pooled(spark, sf):
    return Passages(spark, sf).evidence(language_pool(spark, sf))


# ---- fusion -----------------------------------------------------------------


@query(f"WITH {S.BASE}, {S.LEXICAL} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lexical")
def rank_positions(spark, sf):
    return fusion.rank_positions(Passages(spark, sf).lexical()).withColumn("rank", F.col("rank").cast("long"))


def fused(spark, sf, points=None, k=None) -> tuple[DataFrame, DataFrame]:
    """Lexical, category and phrase rankers over each query's pool, fused; and the phrase evidence."""
    p = Passages(spark, sf, same="lang")
    text = F.lower(F.concat_ws(" ", "path")).alias("category_text")
    pool = p.docs.select("doc_id", "lang", text).join(small(languages(spark, sf)), "lang").select("query_id", "doc_id", "category_text")
    evidence = stored(p.evidence(), "evidence")
    return p.fused(pool, evidence, points, k), evidence


RRF = f"""{POOL}, {S.LEXICAL}, {S.PHRASE}, {AFFINITY},
rows AS (SELECT query_id, doc_id, 'lexical' AS ranker, 1.0::DOUBLE AS w, coalesce(score, 0) AS score FROM pool LEFT JOIN lexical USING (query_id, doc_id)
  UNION ALL SELECT query_id, doc_id, 'phrase', 1.0::DOUBLE, coalesce(score, 0) FROM pool LEFT JOIN evidence USING (query_id, doc_id)
  UNION ALL SELECT query_id, doc_id, 'category', 0.4::DOUBLE, score FROM affinity),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, ranker ORDER BY score DESC, doc_id) AS r, max(abs(score)) OVER (PARTITION BY query_id, ranker) AS signal FROM rows),
fused AS (SELECT query_id, doc_id, round(sum(CASE WHEN signal > 0 THEN w / (60::DOUBLE + r) ELSE 0 END), 12) AS score FROM ranked GROUP BY ALL)"""


@query(f"WITH {S.BASE}, {RRF} SELECT query_id, doc_id, round(score, 6) AS score FROM fused")
def rrf_fusion(spark, sf):
    return fused(spark, sf)[0].select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {S.BASE}, {RRF} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({TOP.format(rows='fused')})")
def fused_topk(spark, sf):
    return fused(spark, sf, k=K)[0].select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {S.BASE}, {S.LEXICAL}, {S.PHRASE},
first AS (SELECT *, 0 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM evidence QUALIFY rank <= 10),
short AS (SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM first GROUP BY query_id HAVING count(*) >= 10)),
more AS (SELECT query_id, doc_id, score * 0.5::DOUBLE AS score, 1 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lexical SEMI JOIN short USING (query_id) QUALIFY rank <= 20),
both_ AS (SELECT * FROM first UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.query_id = m.query_id AND f.doc_id = m.doc_id))
SELECT query_id, doc_id, round(score, 7) AS score, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS position FROM both_ QUALIFY position <= 10""")
def tiered_topup(spark, sf):
    p = Passages(spark, sf)
    out = fusion.tiered(p.evidence(), p.lexical(), K)
    return out.select("query_id", "doc_id", F.round("score", 7).alias("score"), "tier", F.col("position").cast("long").alias("position"))


@query(f"""WITH {S.BASE}, {S.LEXICAL}, {S.PHRASE}, total AS (SELECT query_id, doc_id, round(coalesce(l.score, 0) + 1.6::DOUBLE * coalesce(e.score, 0), 6) AS score
  FROM lexical l FULL JOIN evidence e USING (query_id, doc_id)) {TOP.format(rows='total')}""")
def additive_score(spark, sf):
    p = Passages(spark, sf)
    return top(fusion.additive(p.lexical(), p.evidence()))


# ---- dense ------------------------------------------------------------------

COS = "round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6)"


def vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Query vectors (ids divisible by 20) and all vectors."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vector"))
    return v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "label", "vector"), v


@query(f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) {TOP.format(rows='s')}")
def dense_cosine_topk(spark, sf):
    q, v = vectors(spark, sf)
    return top(rankers.dense_topk(q, v, K))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {COS} AS score FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0) {TOP.format(rows='s')}")
def dense_pooled(spark, sf):
    q, v = vectors(spark, sf)
    return top(rankers.dense_topk(q, v, K, "label"))


@query()
def dense_space_topk(spark, sf):
    """Passages against documents in a space of TF-IDF axes."""
    docs = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    space = dense.fit(docs, dims=32)
    asked = dense.project(questions(spark, sf).select(F.col("query_id").alias("doc_id"), "text"), space).withColumnRenamed("doc_id", "query_id")
    return top(rankers.dense_topk(asked, dense.project(docs, space), K))


# ---- categories -------------------------------------------------------------


@query(f"""WITH {S.PRODUCTS}, hits AS (SELECT query_id, label, length(label) AS n, -position(label IN {S.norm("message")}) AS place FROM said JOIN bucket ON contains({S.norm("message")}, label))
SELECT query_id, label FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, place DESC, label DESC) = 1""")
def label_verbatim_longest(spark, sf):
    return category.by_text(product_messages(spark, sf), category.doc_labels(products(spark, sf)))


OVERLAP = f"""spoken AS (SELECT query_id, {S.toks(S.norm("message"), True)} AS t FROM said),
bare AS (SELECT query_id, list_concat(t, list_transform(list_filter(t, lambda x: x LIKE '%s' AND length(x) > 3), lambda x: left(x, length(x) - 1))) AS t FROM spoken),
forms AS (SELECT DISTINCT query_id, unnest(list_concat(t, list_transform(t, lambda x: x || 's'))) AS term FROM bare),
lab AS (SELECT label, first_doc, len({S.toks("label", True)}) AS n, unnest({S.toks("label", True)}) AS term FROM bucket),
hit AS (SELECT query_id, label, first_doc, round(count(*) / n::DOUBLE * (1 + 0.08::DOUBLE * n), 6) AS score FROM forms JOIN lab USING (term) GROUP BY query_id, label, first_doc, n),
overlap AS (SELECT query_id, label, score FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_doc) = 1)"""


@query(f"WITH {S.PRODUCTS}, {OVERLAP} SELECT * FROM overlap WHERE score >= 0.45")
def label_overlap(spark, sf):
    return category.by_overlap(product_messages(spark, sf), category.doc_labels(products(spark, sf)))


@query(f"""WITH {S.PRODUCTS}, {OVERLAP},
tpl AS (SELECT query_id, {S.norm("regexp_extract(message, '(?i)looking for\\s+(.+?)\\s*(?:[.,]|$)', 1)")} AS label FROM said),
one AS (SELECT t.* FROM tpl t SEMI JOIN bucket USING (label)),
two AS (SELECT query_id, label FROM said JOIN bucket ON contains({S.norm("message")}, label) WHERE query_id NOT IN (SELECT query_id FROM one)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(label) DESC, position(label IN {S.norm("message")}), label DESC) = 1)
SELECT query_id, label, 'template' AS how FROM one UNION ALL SELECT query_id, label, 'text' FROM two
UNION ALL SELECT query_id, label, 'overlap' FROM overlap WHERE score >= 0.45 AND query_id NOT IN (SELECT query_id FROM one UNION SELECT query_id FROM two)""")
def label_recognition(spark, sf):
    return category.find_label(product_messages(spark, sf), category.doc_labels(products(spark, sf)))


@query(f"""WITH {S.PRODUCTS}, asked AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN label WHEN 1 THEN lower(p_type) WHEN 2 THEN 'brand ' || lower(p_type) END AS label
  FROM said JOIN prod ON query_id = doc_id),
part_ AS (SELECT DISTINCT query_id, label, unnest({S.toks("label", True)}) AS token FROM asked WHERE label IS NOT NULL),
tk AS (SELECT DISTINCT token FROM part_),
direct AS (SELECT DISTINCT token, doc_id FROM tk JOIN segs ON segment = token),
word AS (SELECT DISTINCT token, doc_id FROM tk JOIN (SELECT doc_id, unnest(string_split(segment, ' ')) AS w FROM segs) ON w = token WHERE token NOT IN (SELECT token FROM direct)),
hit AS (SELECT DISTINCT query_id, token, doc_id FROM part_ JOIN (SELECT * FROM direct UNION ALL SELECT * FROM word) USING (token)),
known AS (SELECT query_id, count(DISTINCT token) AS k FROM hit GROUP BY query_id),
wide AS (SELECT query_id, doc_id, count(*) AS n FROM hit GROUP BY ALL),
meet AS (SELECT query_id, doc_id FROM wide JOIN known USING (query_id) WHERE n = k),
exact AS (SELECT query_id, doc_id FROM asked JOIN prod USING (label)),
merged AS (SELECT * FROM exact UNION SELECT * FROM meet),
c AS (SELECT query_id, label, (SELECT count(*) FROM part) AS n_all,
  coalesce(e.n, 0) AS ne, coalesce(m.n, 0) AS nm, coalesce(w.n, 0) AS nw FROM asked
  LEFT JOIN (SELECT query_id, count(*) AS n FROM exact GROUP BY 1) e USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM merged GROUP BY 1) m USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM wide GROUP BY 1) w USING (query_id))
SELECT query_id, CASE WHEN label IS NULL THEN 'all' WHEN ne >= 10 THEN 'exact' WHEN nm >= 10 AND ne > 0 THEN 'exact+token' WHEN nm >= 10 THEN 'token' WHEN nw > 0 THEN 'widened' ELSE 'all' END AS mode,
  CASE WHEN label IS NULL THEN n_all WHEN ne >= 10 THEN ne WHEN nm >= 10 THEN nm WHEN nw > 0 THEN nw ELSE n_all END AS n_primary,
  CASE WHEN label IS NULL THEN n_all WHEN (ne >= 10 OR nm >= 10) AND nw > 0 THEN nw ELSE n_all END AS n_fallback FROM c""")
def scope_ladder(spark, sf):
    p = products(spark, sf)
    kind = F.lower(F.element_at("path", 1))
    fourth = F.col("doc_id") % 4
    label = F.when(fourth == 0, X.normalise(X.coarse_label(F.col("path")))).when(fourth == 1, kind).when(fourth == 2, F.concat(F.lit("brand "), kind))
    asked = p.select(F.col("doc_id").alias("query_id"), label.alias("label"))
    # Queries with one label share a pool, so each label is looked up once.
    names = asked.select("label").distinct().withColumn("query_id", F.xxhash64("label"))
    names = stored(names, "labels")
    pool = category.scope(names, category.doc_labels(p), category.doc_segments(p))
    sizes = category.pool_sizes(pool, p.count())
    return asked.join(small(names.withColumnRenamed("query_id", "name")), asked["label"].eqNullSafe(names["label"])).join(sizes.withColumnRenamed("query_id", "name"), "name").select("query_id", "mode", "n_primary", "n_fallback")


# ---- turns and sessions -----------------------------------------------------

SEP = "chr(1)"
CUT = f"string_split(regexp_replace(regexp_replace({{x}}, ';', {SEP}, 'g'), '([a-z0-9])\\.\\s+([A-Z])', '\\1' || {SEP} || '\\2', 'g'), {SEP})"
PIECES = f"list_filter(list_transform({CUT}, lambda s: trim(trim(trim(s), '.,;:!? '))), lambda s: length(s) >= 3)"
LEAD = T.LEAD_MARKER.replace("'", "''").replace("{0,80}", "{{0,80}}")
BARE = f"trim(trim(regexp_replace({{s}}, '{LEAD}', ''), '.,;:!? '))"
EMPTY = T.EMPTY_TURN.replace("'", "''")


@query(f"WITH {S.TURNS} SELECT session, turn, {PIECES.format(x='trim(message)')} AS pieces FROM turns")
def turn_segments(spark, sf):
    t = session.numbered(session_turns(spark, sf))
    return t.select("session", F.col("turn").cast("long").alias("turn"), T.segments(F.trim("message")).alias("pieces"))


@query(f"WITH {S.TURNS}, p AS (SELECT session, turn, unnest({PIECES.format(x='trim(message)')}) AS piece, generate_subscripts({PIECES.format(x='trim(message)')}, 1) - 1 AS pos FROM turns) SELECT session, turn, pos::INT AS pos, {BARE.format(s='piece')} AS bare FROM p")
def lead_strip(spark, sf):
    t = session.numbered(session_turns(spark, sf))
    rows = t.select("session", F.col("turn").cast("long").alias("turn"), F.posexplode(T.segments(F.trim("message"))).alias("pos", "piece"))
    return rows.select("session", "turn", "pos", T.lead_stripped(F.col("piece")).alias("bare"))


@query(f"""WITH {S.TURNS} SELECT session, turn, regexp_matches(message, '{EMPTY}') AS is_empty, regexp_matches(message, '{T.OVERRIDE}') AS is_override,
  regexp_matches(lower(message), '{T.SLOT_OVERRIDE}') AS is_slot_override FROM turns""")
def empty_override_flags(spark, sf):
    m = F.col("message")
    t = session.numbered(session_turns(spark, sf))
    return t.select("session", F.col("turn").cast("long").alias("turn"), T.is_empty_turn(m).alias("is_empty"), T.is_override(m).alias("is_override"), T.is_slot_override(m).alias("is_slot_override"))


SLOT_TEXT = """said2 AS (SELECT query_id, lower(message || CASE query_id % 5 WHEN 0 THEN ' under $' || (query_id % 90)::VARCHAR WHEN 1 THEN ' size xl, black nike' WHEN 2 THEN ' at least 4 stars, over 20' WHEN 3 THEN ' red boots, 4.5 rated' ELSE '' END) AS m FROM said)"""


def slot_messages(spark, sf) -> DataFrame:
    fifth = F.col("query_id") % 5
    tail = F.when(fifth == 0, F.concat(F.lit(" under $"), (F.col("query_id") % 90).cast("string"))).when(fifth == 1, " size xl, black nike").when(fifth == 2, " at least 4 stars, over 20").when(fifth == 3, " red boots, 4.5 rated").otherwise("")
    return product_messages(spark, sf).withColumn("message", F.concat("message", tail))


def slot_sql(name: str) -> str:
    pattern, group, _ = T.SLOTS[name]
    value = f"nullif(regexp_extract(m, '{pattern}', {group}), '')"
    return f"CAST({value} AS DOUBLE)" if name in T.NUMERIC_SLOTS else value


SLOT_ROWS = f"{SLOT_TEXT}, slot AS (SELECT query_id, m, {', '.join(f'{slot_sql(n)} AS {n}' for n in T.SLOTS)} FROM said2)"
BROWSE = " OR ".join(f"contains(m, '{w}')" for w in T.BROWSING_WORDS)
SCORE = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for n, (_, _, w) in T.SLOTS.items())


@query(f"WITH {S.PRODUCTS}, {SLOT_ROWS} SELECT query_id, {', '.join(T.SLOTS)} FROM slot")
def slot_extract(spark, sf):
    m = slot_messages(spark, sf)
    return m.select("query_id", *[c.alias(n) for n, c in T.slots(F.col("message")).items()])


@query(f"""WITH {S.PRODUCTS}, {SLOT_ROWS}, x AS (SELECT query_id, round({SCORE}, 6) AS score, ({BROWSE}) AS b, (size IS NOT NULL)::INT + (color IS NOT NULL)::INT + (store IS NOT NULL)::INT AS e FROM slot)
SELECT query_id, score, CASE WHEN e > 0 OR (score >= 0.7 AND NOT b) THEN 'BUYING' WHEN b AND score < 0.4 THEN 'BROWSING' WHEN score >= 0.4 THEN 'BUYING' ELSE 'BROWSING' END AS track,
  (CASE WHEN e >= 2 THEN 0.95 WHEN e > 0 THEN 0.85 WHEN score >= 0.7 AND NOT b THEN 0.75 WHEN b AND score < 0.4 THEN 0.85 WHEN score >= 0.4 THEN 0.7 ELSE 0.6 END)::DOUBLE AS confidence FROM x""")
def intent_route(spark, sf):
    m = slot_messages(spark, sf)
    found = T.slots(F.col("message"))
    rows = m.select("query_id", "message", *[c.alias(n) for n, c in found.items()])
    return rows.select("query_id", *[c.alias(n) for n, c in T.intent(F.col("message"), {n: F.col(n) for n in found}).items()])


@query(f"""WITH {S.PRODUCTS}, {SLOT_ROWS}, x AS (SELECT *, round({SCORE}, 6) AS score FROM slot)
SELECT query_id, score, score < 0.5 AS vague, CASE WHEN size IS NULL THEN 'size' WHEN color IS NULL THEN 'color' WHEN store IS NULL THEN 'brand' WHEN main_category IS NULL THEN 'category' ELSE 'other' END AS ask,
  list_filter(list_distinct([store, main_category, color, size]), lambda v: v IS NOT NULL AND length(v) >= 3).list_sort() AS phrases FROM x""")
def specificity(spark, sf):
    found = T.slots(F.col("message"))
    rows = slot_messages(spark, sf).select("query_id", *[c.alias(n) for n, c in found.items()])
    named = {n: F.col(n) for n in found}
    score = T.specificity(named)
    return rows.select("query_id", score.alias("score"), T.too_general(score).alias("vague"), T.clarify_attribute(named).alias("ask"), F.sort_array(T.router_phrases(named)).alias("phrases"))


@query(f"""WITH {S.PRODUCTS}, {SLOT_ROWS}, x AS (SELECT *, list_filter([CASE WHEN size IS NULL THEN 'size' END, CASE WHEN color IS NULL THEN 'color' END, CASE WHEN store IS NULL THEN 'brand' END,
  CASE WHEN contains(m, 'price') AND price_max IS NULL THEN 'price range' END], lambda v: v IS NOT NULL) AS miss, coalesce(main_category, 'items') AS about FROM slot)
SELECT query_id, CASE WHEN len(miss) > 0 THEN 'I found many results for ' || about || '! To help me narrow this down, could you specify your ' || array_to_string(miss[1:3], ', ') || '?'
  ELSE 'Could you provide a bit more detail on what kind of ' || about || ' you''re looking for?' END AS message FROM x""")
def clarification(spark, sf):
    found = T.slots(F.col("message"))
    rows = slot_messages(spark, sf).select("query_id", "message", *[c.alias(n) for n, c in found.items()])
    asked = T.clarify_text({n: F.col(n) for n in found}, F.contains(F.lower("message"), F.lit("price")))
    return rows.select("query_id", asked.alias("message"))


#: Labels, constraints and words of sessions as the fold has them.
FOLD = f"""{S.TURNS},
flagged AS (SELECT *, regexp_matches(message, '{T.OVERRIDE}') AS over_, regexp_matches(message, '{EMPTY}') AS none_, min(CASE WHEN found IS NOT NULL THEN turn END) OVER (PARTITION BY session) AS first_ FROM turns),
ev AS (SELECT *, CASE WHEN turn = first_ OR (turn > first_ AND over_) THEN found END AS e FROM flagged),
labelled AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn) AS label FROM ev),
clean AS (SELECT *, CASE WHEN label IS NULL THEN trim(message) ELSE regexp_replace(trim(message), regexp_escape(label), ' ', 'gi') END AS x FROM labelled),
piece AS (SELECT session, turn, unnest({PIECES.format(x='x')}) AS p, generate_subscripts({PIECES.format(x='x')}, 1) AS pos FROM clean WHERE NOT none_),
pref AS (SELECT session, turn, pos, CASE WHEN length({BARE.format(s='p')}) >= 3 THEN {BARE.format(s='p')} ELSE p END AS value FROM piece),
con AS (SELECT session, turn, pos, value FROM pref QUALIFY row_number() OVER (PARTITION BY session, value ORDER BY turn, pos) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn, pos) - 1 AS place FROM con)"""


@query(f"""WITH {FOLD}, w AS (SELECT session, word, min(turn) AS turn FROM (SELECT session, turn, unnest({S.toks('value')}) AS word FROM con) GROUP BY ALL)
SELECT session, turn, label, over_ AS is_override, (SELECT count(*) FROM con c WHERE c.session = l.session AND c.turn <= l.turn) AS n_constraints,
  coalesce((SELECT max((SELECT count(*) FROM con c WHERE c.session = o.session AND c.turn < o.turn)) FROM flagged o WHERE o.session = l.session AND o.turn <= l.turn AND o.over_), 0) AS n_revoked,
  (SELECT count(*) FROM w WHERE w.session = l.session AND w.turn <= l.turn) AS evidence_words,
  turn <= 3 AND (SELECT count(*) FROM w WHERE w.session = l.session AND w.turn <= l.turn) < 4 AS hold FROM labelled l""")
def session_fold(spark, sf):
    return session.fold(session_turns(spark, sf)).withColumn("turn", F.col("turn").cast("long"))


@query(f"""WITH {FOLD}, last_ AS (SELECT session, max(turn) AS last, max(CASE WHEN over_ THEN turn END) AS over_turn FROM flagged GROUP BY session)
SELECT session, place, value, last - turn AS age, coalesce(turn < over_turn, false) AS revoked, round(0.8::DOUBLE ** (last - turn) * CASE WHEN turn < over_turn THEN 0.5 ELSE 1 END, 6)::DOUBLE AS weight FROM placed JOIN last_ USING (session)""")
def slot_decay(spark, sf):
    out = session.decay(session_turns(spark, sf))
    return out.withColumns({"place": F.col("place").cast("long"), "age": F.col("age").cast("long")})


@query(f"""WITH {FOLD}, w AS (SELECT session, count(DISTINCT word) AS evidence_words FROM (SELECT session, unnest({S.toks('value')}) AS word FROM con) GROUP BY session)
SELECT DISTINCT session, coalesce(evidence_words, 0) AS evidence_words FROM turns LEFT JOIN w USING (session)""")
def evidence_words(spark, sf):
    rows = session.fold(session_turns(spark, sf))
    return rows.groupBy("session").agg(F.max("evidence_words").alias("evidence_words"))


@query(f"""WITH {FOLD}, w AS (SELECT session, word, min(turn) AS turn FROM (SELECT session, turn, unnest({S.toks('value')}) AS word FROM con) GROUP BY ALL)
SELECT turn, count(*) AS sessions, sum((turn <= 3 AND (SELECT count(*) FROM w WHERE w.session = l.session AND w.turn <= l.turn) < 4)::INT)::BIGINT AS held FROM labelled l GROUP BY turn""")
def hold_flag(spark, sf):
    rows = session.fold(session_turns(spark, sf))
    return rows.groupBy(F.col("turn").cast("long").alias("turn")).agg(F.count("*").alias("sessions"), F.sum(F.col("hold").cast("int")).alias("held"))


def state_ctes() -> str:
    """slots: the last value so far of every slot, the categories so far in order and whether a price was mentioned."""
    now = ", ".join(f"{slot_sql(n)} AS now_{n}" for n in T.SLOTS)
    last = ", ".join(f"last_value(now_{n} IGNORE NULLS) OVER w AS {n}" for n in T.SLOTS)
    return f"""said_low AS (SELECT session, turn, lower(message) AS m FROM turns), now_slots AS (SELECT session, turn, m, {now} FROM said_low),
kinds AS (SELECT session, now_main_category AS c, min(turn) AS since FROM now_slots WHERE now_main_category IS NOT NULL GROUP BY ALL),
slots AS (SELECT session, turn, {last}, bool_or(contains(m, 'price')) OVER w AS price_mentioned,
  coalesce((SELECT list(c ORDER BY since) FROM kinds k WHERE k.session = s.session AND k.since <= s.turn), []) AS categories
  FROM now_slots s WINDOW w AS (PARTITION BY session ORDER BY turn))"""


@query(f"WITH {S.TURNS}, {state_ctes()} SELECT session, turn, {', '.join(T.SLOTS)}, array_to_string(categories, ',') AS categories, price_mentioned FROM slots")
def slot_state(spark, sf):
    rows = session.slot_state(session_turns(spark, sf))
    return rows.withColumns({"turn": F.col("turn").cast("long"), "categories": F.array_join("categories", ",")})


@query(f"""WITH {S.TURNS}, {state_ctes()} SELECT session, turn, main_category AS category, array_to_string(categories, ',') AS categories, store, price_max, price_min, min_rating, size, color,
  len(list_filter([main_category, store, price_max::VARCHAR, price_min::VARCHAR, min_rating::VARCHAR, CASE WHEN len(categories) > 0 THEN 'y' END, coalesce(size, color)], lambda v: v IS NOT NULL))::INT AS n_keys FROM slots""")
def session_memory(spark, sf):
    memory = session.distilled(session.slot_state(session_turns(spark, sf)))
    shape = "category string, categories array<string>, store string, price_max double, price_min double, min_rating double, details struct<size:string,color:string>"
    rows = memory.withColumn("m", F.from_json("json", shape))
    return rows.select(
        "session", F.col("turn").cast("long").alias("turn"), "m.category", F.coalesce(F.array_join("m.categories", ","), F.lit("")).alias("categories"), "m.store", "m.price_max", "m.price_min", "m.min_rating",
        "m.details.size", "m.details.color", F.coalesce(F.size(F.json_object_keys("json")), F.lit(0)).alias("n_keys"),
    )


@query(f"WITH {S.TURNS} SELECT session, turn, list(message) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS context FROM turns")
def last_turns(spark, sf):
    rows = session.numbered(session_turns(spark, sf))
    return session.last_turns(rows).withColumn("turn", F.col("turn").cast("long"))


#: Every form of every piece for phrase evidence, at its first turn.
FORMS = f"""formed AS (SELECT session, turn, p, {BARE.format(s='p')} AS bare FROM piece),
based AS (SELECT session, turn, p, bare, CASE WHEN bare <> '' THEN bare ELSE p END AS base FROM formed),
form AS (SELECT session, turn, p AS phrase FROM based UNION ALL SELECT session, turn, bare FROM based WHERE bare <> p AND length(bare) >= 3
  UNION ALL SELECT session, turn, x FROM (SELECT session, turn, trim(trim(unnest(regexp_split_to_array(base, '(?i)\\band\\b')), '.,;:!? ')) AS x FROM based WHERE regexp_matches(base, '(?i)\\band\\b')) WHERE length(x) >= 4),
phr AS (SELECT session, phrase, min(turn) AS turn FROM form GROUP BY ALL)"""


@query(f"WITH {FOLD}, {FORMS} SELECT session, turn, phrase FROM phr")
def session_phrases(spark, sf):
    out = session.phrases(session.sticky_label(session.numbered(session_turns(spark, sf))))
    return out.withColumn("turn", F.col("turn").cast("long"))


# ---- a session's turn -------------------------------------------------------

#: Every turn ranked by what its session has said so far: scope, rankers over the pool, fusion, the gate and what is said.
RESPOND = f"""{FOLD}, {FORMS}, {S.PRODUCTS}, {state_ctes()},
pt AS (SELECT doc_id, unnest({S.toks("title")}) AS term, 3.0 AS w FROM prod UNION ALL SELECT doc_id, unnest({S.toks("categories")}), 2.0 FROM prod UNION ALL SELECT doc_id, unnest({S.toks("store")}), 1.5 FROM prod),
post AS (SELECT term, doc_id, sum(w)::DOUBLE AS tf FROM pt GROUP BY ALL),
lens AS (SELECT doc_id, coalesce(sum(tf), 0) AS len FROM prod LEFT JOIN post USING (doc_id) GROUP BY doc_id),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM lens),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, stats GROUP BY term, n),
body AS (SELECT doc_id, {S.norm("title || ' ' || categories || ' ' || store")} AS body, {S.norm("categories")} AS category_text FROM prod),
names AS (SELECT DISTINCT label FROM labelled WHERE label IS NOT NULL),
lt AS (SELECT DISTINCT label, unnest({S.toks("label", True)}) AS token FROM names),
direct AS (SELECT DISTINCT token, doc_id FROM lt JOIN segs ON segment = token),
word AS (SELECT DISTINCT token, doc_id FROM lt JOIN (SELECT doc_id, unnest(string_split(segment, ' ')) AS w FROM segs) ON w = token WHERE token NOT IN (SELECT token FROM direct)),
hit AS (SELECT DISTINCT label, token, doc_id FROM lt JOIN (SELECT * FROM direct UNION ALL SELECT * FROM word) USING (token)),
wide AS (SELECT label, doc_id, count(*) AS n FROM hit GROUP BY ALL),
exact AS (SELECT label, doc_id FROM names JOIN prod USING (label)),
merged AS (SELECT * FROM exact UNION SELECT label, doc_id FROM wide JOIN (SELECT label, count(DISTINCT token) AS k FROM hit GROUP BY label) USING (label) WHERE n = k),
mode AS (SELECT label, (SELECT count(*) FROM exact e WHERE e.label = x.label) AS ne, (SELECT count(*) FROM merged m WHERE m.label = x.label) AS nm, (SELECT count(*) FROM wide w WHERE w.label = x.label) AS nw FROM names x),
scope AS (SELECT label, doc_id FROM exact JOIN mode USING (label) WHERE ne >= 10 UNION ALL SELECT label, doc_id FROM merged JOIN mode USING (label) WHERE ne < 10 AND nm >= 10
  UNION ALL SELECT label, doc_id FROM wide JOIN mode USING (label) WHERE ne < 10 AND nm < 10 UNION ALL SELECT mode.label, doc_id FROM mode, prod WHERE ne < 10 AND nm < 10 AND nw = 0),
pool AS (SELECT session, turn, doc_id FROM labelled JOIN scope USING (label) UNION ALL SELECT session, turn, doc_id FROM labelled, prod WHERE labelled.label IS NULL),
qt AS (SELECT session, turn, term, sum(1)::DOUBLE AS w FROM (SELECT t.session, t.turn, unnest({S.toks("value")}) AS term FROM turns t JOIN con c ON c.session = t.session AND c.turn <= t.turn
  UNION ALL SELECT session, turn, unnest({S.toks("label")}) FROM labelled WHERE label IS NOT NULL) GROUP BY ALL),
lexical AS (SELECT session, turn, doc_id, round(sum({S.BM25}), 6) AS score FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN lens USING (doc_id) JOIN pool USING (session, turn, doc_id), stats GROUP BY ALL),
spoken AS (SELECT DISTINCT t.session, t.turn, {S.norm("p.phrase")} AS phrase FROM turns t JOIN phr p ON p.session = t.session AND p.turn <= t.turn),
rarity AS (SELECT session, turn, phrase, least(greatest(avg(coalesce(idf, 0)) / 10, 0.05), 1.0)::DOUBLE AS rarity
  FROM (SELECT session, turn, phrase, unnest({S.toks("phrase")}) AS term FROM spoken WHERE length(phrase) >= 8) LEFT JOIN idf USING (term) GROUP BY ALL),
evidence AS (SELECT session, turn, doc_id, round(sum(rarity), 6) AS score FROM rarity JOIN pool USING (session, turn) JOIN body USING (doc_id) WHERE contains(body, phrase) GROUP BY ALL),
affinity AS (SELECT session, turn, doc_id, round(sum(idf), 6) AS score FROM pool JOIN body USING (doc_id) JOIN qt USING (session, turn) JOIN idf USING (term) WHERE contains(category_text, term) GROUP BY ALL),
ranker_rows AS (SELECT session, turn, doc_id, 'lexical' AS ranker, 1.0::DOUBLE AS rw, coalesce(score, 0) AS score FROM pool LEFT JOIN lexical USING (session, turn, doc_id)
  UNION ALL SELECT session, turn, doc_id, 'phrase', 1.0::DOUBLE, coalesce(score, 0) FROM pool LEFT JOIN evidence USING (session, turn, doc_id)
  UNION ALL SELECT session, turn, doc_id, 'category', 0.4::DOUBLE, coalesce(score, 0) FROM pool LEFT JOIN affinity USING (session, turn, doc_id)),
placed_rows AS (SELECT *, row_number() OVER (PARTITION BY session, turn, ranker ORDER BY score DESC, doc_id) AS r, max(abs(score)) OVER (PARTITION BY session, turn, ranker) AS signal FROM ranker_rows),
total AS (SELECT session, turn, doc_id, round(sum(CASE WHEN signal > 0 THEN rw / (60::DOUBLE + r) ELSE 0 END), 12) AS score FROM placed_rows GROUP BY ALL),
best AS (SELECT session, turn, doc_id, score, row_number() OVER (PARTITION BY session, turn ORDER BY score DESC, doc_id) AS place FROM total QUALIFY place <= 10),
seen AS (SELECT session, word, min(turn) AS turn FROM (SELECT session, turn, unnest({S.toks('value')}) AS word FROM con) GROUP BY ALL),
gate AS (SELECT session, turn, label, turn <= 3 AND (SELECT count(*) FROM seen w WHERE w.session = l.session AND w.turn <= l.turn) < 4 AS held FROM labelled l),
lent AS (SELECT session, turn, held, s.size, s.color, s.store, s.price_max, s.price_mentioned, s.main_category,
  CASE WHEN held AND s.main_category IS NULL THEN array_to_string(list_filter(string_split(label, ' '), lambda w, i: list_position(string_split(label, ' '), w) = i), ' ') END AS lends FROM gate JOIN slots s USING (session, turn)),
about AS (SELECT *, coalesce(main_category, first_value(lends IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn), 'items') AS topic,
  list_filter([CASE WHEN size IS NULL THEN 'size' END, CASE WHEN color IS NULL THEN 'color' END, CASE WHEN store IS NULL THEN 'brand' END, CASE WHEN price_mentioned AND price_max IS NULL THEN 'price range' END], lambda v: v IS NOT NULL) AS miss FROM lent),
reply AS (SELECT session, turn, held, CASE WHEN NOT held THEN 'Here are the closest matches I found.' WHEN len(miss) > 0 THEN 'I found many results for ' || topic || '! To help me narrow this down, could you specify your ' || array_to_string(miss[1:3], ', ') || '?'
  ELSE 'Could you provide a bit more detail on what kind of ' || topic || ' you''re looking for?' END AS message FROM about)"""


def shown(rows: DataFrame) -> DataFrame:
    """Responses with their lists of ids as text."""
    ids = F.array_join(F.transform("recommendations", lambda r: r["parent_asin"]), ",")
    return rows.withColumns({"turn": F.col("turn").cast("long"), "ids": ids, "prompt_tokens": F.col("usage.prompt_tokens")})


@query(f"""WITH {RESPOND} SELECT r.session, r.turn, message, 'other' AS ask_attribute, held,
  coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY place) FROM best b WHERE b.session = r.session AND b.turn = r.turn AND NOT r.held), '') AS ids, 0::BIGINT AS prompt_tokens FROM reply r""")
def respond_turns(spark, sf):
    idx = search.build_index(products(spark, sf), search.Config())
    return shown(search.respond(session_turns(spark, sf), idx)).select("session", "turn", "message", "ask_attribute", "held", "ids", "prompt_tokens")


@query(f"""WITH {RESPOND} SELECT r.session, r.turn, held, CASE WHEN held THEN 'held' ELSE 'llm_ok' END AS status,
  coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY place DESC) FROM best b WHERE b.session = r.session AND b.turn = r.turn AND NOT r.held), '') AS ids,
  CASE WHEN held THEN 0 ELSE 120 END::BIGINT AS prompt_tokens FROM reply r""")
def respond_reranked(spark, sf):
    """The same turns in the order of a stand-in for a model that turns every list around."""
    idx = search.build_index(products(spark, sf), search.Config())
    out = search.respond(session_turns(spark, sf), idx, call=rerank.stub("reverse"), use_model=True)
    return shown(out).select("session", "turn", "held", "status", "ids", "prompt_tokens")


@query(f"""WITH {RESPOND} SELECT r.session, r.turn, CASE WHEN (r.session + r.turn) % 3 = 0 THEN 'Better.' ELSE message END AS message,
  CASE (r.session + r.turn) % 3 WHEN 1 THEN 'enhance: ValueError: no answer' WHEN 2 THEN 'enhance contract: message must be a string' END AS failure FROM reply r""")
def respond_resilient(spark, sf):
    """Responses through a plug-in that betters a third of them, fails on a third and breaks the contract on a third."""
    idx = search.build_index(products(spark, sf), search.Config())
    out = search.resilient(search.respond(session_turns(spark, sf), idx), third_time_lucky)
    return out.select("session", F.col("turn").cast("long").alias("turn"), "message", "failure")


def third_time_lucky(prompt: str) -> dict:
    """A plug-in for the query above."""
    said = json.loads(prompt)
    kind = (said["session"] + said["turn"]) % 3
    if kind == 1:
        raise ValueError("no answer")
    return said["response"] | {"message": "Better." if kind == 0 else 42}


# ---- contract ---------------------------------------------------------------

PAYLOAD = "payload AS (SELECT conv_id AS query_id, [(conv_id % 50)::VARCHAR, ' ' || (conv_id % 50)::VARCHAR || ' ', 'bad', '', (conv_id % 7)::VARCHAR, (conv_id * 3)::VARCHAR] AS ids, conv_id FROM (SELECT DISTINCT conv_id FROM conversations))"


def payloads(spark, sf) -> DataFrame:
    """One raw list of ids per conversation, with repeats, blanks and unknown ids."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    q = F.col("query_id")
    fifty = (q % 50).cast("string")
    return c.withColumn("ids", F.array(fifty, F.concat(F.lit(" "), fifty, F.lit(" ")), F.lit("bad"), F.lit(""), (q % 7).cast("string"), (q * 3).cast("string")))


@query(f"""WITH {PAYLOAD}, e AS (SELECT query_id, trim(unnest(ids)) AS id, generate_subscripts(ids, 1) AS pos FROM payload),
f AS (SELECT query_id, id, min(pos) AS pos FROM e SEMI JOIN (SELECT p_partkey::VARCHAR AS id FROM part) USING (id) WHERE id <> '' GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS position FROM f QUALIFY position <= 10""")
def recommendations_normalise(spark, sf):
    return contract.normalise_recommendations(payloads(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id")))


def responses(spark, sf) -> DataFrame:
    q = F.col("query_id")
    ask = F.when(q % 3 == 0, "color").when(q % 3 == 1, "mood")
    return payloads(spark, sf).withColumns({"message": F.when(q % 4 != 0, "here"), "ask": ask, "prompt_tokens": q % 5 - 1, "completion_tokens": F.when(q % 6 != 0, q % 9)})


RESPONSE = f"{PAYLOAD}, r AS (SELECT query_id, ids, CASE WHEN query_id % 4 <> 0 THEN 'here' END AS message, CASE query_id % 3 WHEN 0 THEN 'color' WHEN 1 THEN 'mood' END AS ask, query_id % 5 - 1 AS pt, CASE WHEN query_id % 6 <> 0 THEN query_id % 9 END AS ct FROM payload)"


@query(f"""WITH {RESPONSE} SELECT query_id, list_filter([CASE WHEN message IS NULL THEN 'message must be a string' END, CASE WHEN ask = 'mood' THEN 'ask_attribute is not an allowed value' END,
  CASE WHEN list_contains(ids, '') THEN 'recommendation has no id' END, CASE WHEN len(list_filter(ids, lambda x: x <> '')) > len(list_distinct(list_filter(ids, lambda x: x <> ''))) THEN 'recommendation repeats an id' END,
  CASE WHEN pt < 0 THEN 'usage.prompt_tokens must be a non-negative integer' END, CASE WHEN ct IS NULL THEN 'usage.completion_tokens must be a non-negative integer' END], lambda x: x IS NOT NULL) AS problems FROM r""")
def contract_violations(spark, sf):
    usage = {n: F.col(n) for n in ("prompt_tokens", "completion_tokens")}
    return responses(spark, sf).select("query_id", contract.violations(F.col("message"), F.col("ask"), F.col("ids"), usage).alias("problems"))


@query(f"""WITH {RESPONSE}, e AS (SELECT query_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM r), f AS (SELECT query_id, id, min(pos) AS pos FROM e WHERE id <> '' GROUP BY ALL)
SELECT query_id, coalesce(message, '') AS message, CASE WHEN ask = 'color' THEN ask END AS ask_attribute, (SELECT string_agg(id, ',' ORDER BY pos) FROM f WHERE f.query_id = r.query_id) AS ids,
  CASE WHEN pt >= 0 AND ct IS NOT NULL THEN pt ELSE 0 END AS prompt_tokens, CASE WHEN pt >= 0 AND ct IS NOT NULL THEN ct ELSE 0 END AS completion_tokens FROM r""")
def contract_coerce(spark, sf):
    usage = {n: F.col(n) for n in ("prompt_tokens", "completion_tokens")}
    scores = F.transform("ids", lambda x: F.lit(None).cast("double"))
    fixed = contract.coerced(F.col("message"), F.col("ask"), F.col("ids"), scores, usage)
    ids = F.array_join(F.transform(fixed.pop("recommendations"), lambda x: x["id"]), ",")
    return responses(spark, sf).select("query_id", *[c.alias(n) for n, c in fixed.items()], ids.alias("ids"))


@query(f"WITH {S.BASE}, {S.LEXICAL}, t AS ({TOP.format(rows='lexical')}) SELECT query_id, 'Here you are.' AS message, 'other' AS ask_attribute, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids, 0::BIGINT AS prompt_tokens FROM t GROUP BY query_id")
def response_build(spark, sf):
    ranked = top(Passages(spark, sf).lexical()).withColumn("id", F.col("doc_id").cast("string"))
    out = contract.build(ranked, F.lit("Here you are."), F.lit("other"))
    return out.select("query_id", "message", "ask_attribute", F.array_join(F.transform("recommendations", lambda r: r["parent_asin"]), ",").alias("ids"), F.col("usage.prompt_tokens").alias("prompt_tokens"))


@query(f"WITH {S.BASE}, {S.LEXICAL}, t AS ({TOP.format(rows='lexical')}) SELECT query_id, t.doc_id, rank, lang, source, quality::DOUBLE AS quality FROM t LEFT JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)")
def enrich_left_join(spark, sf):
    ranked = top(Passages(spark, sf).lexical()).drop("score")
    meta = documents(spark, sf).select("doc_id", "lang", "source")
    return contract.enrich(contract.enrich(ranked, meta), table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")))


@query(f"""WITH {S.BASE}, {S.LEXICAL}, t AS ({TOP.format(rows='lexical')}), a AS (SELECT query_id, doc_id, 100 - rank AS back FROM t WHERE doc_id % 3 <> 0)
SELECT query_id, t.doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY back IS NULL, coalesce(back, rank)) AS position FROM t LEFT JOIN a USING (query_id, doc_id)""")
def rerank_reconcile(spark, sf):
    given = stored(top(Passages(spark, sf).lexical()).withColumnRenamed("rank", "position"), "given")
    # An answer in reverse order that leaves out every third id and invents one.
    said = given.filter("doc_id % 3 <> 0").select("query_id", "doc_id", (100 - F.col("position")).alias("position"))
    invented = given.select("query_id", F.lit(-1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("position")).distinct()
    out = contract.reconcile(given, said.unionByName(invented))
    return out.withColumn("position", F.col("position").cast("long"))


@query(f"WITH {S.BASE}, {S.LEXICAL}, t AS ({TOP.format(rows='lexical')}) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS position FROM t")
def rerank_plugin(spark, sf):
    given = stored(top(Passages(spark, sf).lexical()).withColumnRenamed("rank", "position"), "given")
    items = F.transform(F.sort_array(F.collect_list(F.struct("position", "doc_id"))), lambda x: F.struct(x["doc_id"].alias("doc_id")))
    asked = given.groupBy("query_id").agg(rerank.prompts(F.lit("{}"), F.array(F.lit("")), items).alias("prompt"))
    out = rerank.rerank(given, rerank.answers(asked, rerank.stub("reverse")))
    return out.withColumn("position", F.col("position").cast("long"))


@query("""SELECT CASE WHEN item_id % 40 = 0 THEN 'timed_out' WHEN item_id % 5 = 1 THEN 'failed' WHEN item_id % 5 = 2 THEN 'no_key' ELSE 'llm_ok' END AS status, count(*) AS n FROM benchmark GROUP BY 1""")
def rerank_counters(spark, sf):
    """Every status: some calls hang, some fail, some have no key; hung calls cost only themselves."""
    asked = questions(spark, sf).select("query_id", F.to_json(F.struct(F.col("query_id").alias("q"))).alias("prompt"))
    keyless = (F.col("query_id") % 5 == 2) & (F.col("query_id") % 40 != 0)
    got = rerank.answers(asked.filter(~keyless), moody, deadline=1.0).unionByName(rerank.answers(asked.filter(keyless), None))
    return rerank.counters(got)


def moody(prompt: str) -> list[int]:
    """A plug-in for the query above."""
    q = json.loads(prompt)["q"]
    if q % 40 == 0:
        time.sleep(30)
    if q % 5 == 1:
        raise ValueError("no answer")
    return [q]


RAW_KINDS = """['{"message": "hi", "ask_attribute": null, "recommendations": [{"parent_asin": "A", "score": 1.5}, {"parent_asin": "B"}]}',
  '{"message": 42, "ask_attribute": "mood", "recommendations": "nope"}', '{"message": "hi", "recommendations": [{"parent_asin": "A", "rank": 1}, {"parent_asin": "A"}, 7, {"parent_asin": ""}]}',
  '{"message": "hi", "ask_attribute": "size", "recommendations": [], "usage": {"prompt_tokens": -1, "completion_tokens": 2.5}}', '{"message": null, "ask_attribute": 3, "usage": 5, "recommendations": [null]}', '[1]', 'no JSON']"""


@query(f"""WITH r AS (SELECT DISTINCT conv_id AS query_id, {RAW_KINDS}[(conv_id % 7 + 1)::INT] AS raw FROM conversations),
j AS (SELECT query_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r),
k AS (SELECT query_id, j, coalesce(json_type(j), '') = 'OBJECT' AS is_object, coalesce(json_type(j, '$.message'), '') AS m, json_type(j, '$.ask_attribute') AS a, j ->> '$.ask_attribute' AS ask,
  coalesce(json_type(j, '$.recommendations'), '') = 'ARRAY' AS is_list, CASE WHEN json_type(j, '$.recommendations') = 'ARRAY' THEN json_extract(j, '$.recommendations[*]') ELSE [] END AS items,
  coalesce(json_type(j, '$.usage'), 'NULL') AS u, json_type(j, '$.usage.prompt_tokens') AS pt, json_type(j, '$.usage.completion_tokens') AS ct FROM j),
o AS (SELECT *, list_filter(items, lambda x: json_type(x) = 'OBJECT') AS objects FROM k),
i AS (SELECT *, list_filter(list_transform(objects, lambda x: CASE WHEN json_type(x, '$.parent_asin') = 'VARCHAR' THEN x ->> '$.parent_asin' END), lambda x: x <> '') AS ids FROM o)
SELECT query_id, CASE WHEN NOT is_object THEN ['response is not an object'] ELSE list_filter([CASE WHEN m <> 'VARCHAR' THEN 'message must be a string' END,
  CASE WHEN a IS NULL THEN 'ask_attribute key is required' WHEN a <> 'NULL' AND NOT (a = 'VARCHAR' AND ask IN ({S.strings(contract.ATTRIBUTES)})) THEN 'ask_attribute is not an allowed value' END,
  CASE WHEN NOT is_list THEN 'recommendations must be a list' END, CASE WHEN len(objects) < len(items) THEN 'recommendation is not an object' END, CASE WHEN len(ids) < len(objects) THEN 'recommendation has no id' END,
  CASE WHEN len(list_distinct(ids)) < len(ids) THEN 'recommendation repeats an id' END, CASE WHEN len(list_filter(objects, lambda x: len(list_filter(json_keys(x), lambda n: n NOT IN ('parent_asin', 'score'))) > 0)) > 0 THEN 'recommendation has extra keys' END,
  CASE WHEN u NOT IN ('NULL', 'OBJECT') THEN 'usage must be an object' END, CASE WHEN u = 'OBJECT' AND NOT (coalesce(pt, '') IN ('BIGINT', 'UBIGINT') AND (j ->> '$.usage.prompt_tokens')::DOUBLE >= 0) THEN 'usage.prompt_tokens must be a non-negative integer' END,
  CASE WHEN u = 'OBJECT' AND NOT (coalesce(ct, '') IN ('BIGINT', 'UBIGINT') AND (j ->> '$.usage.completion_tokens')::DOUBLE >= 0) THEN 'usage.completion_tokens must be a non-negative integer' END], lambda x: x IS NOT NULL) END AS problems FROM i""")
def contract_json(spark, sf):
    """Responses as JSON text, of wrong types, with missing and extra keys."""
    kinds = F.array(*[F.lit(k) for k in re.findall(r"'([^']*)'", RAW_KINDS)])
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    return rows.select("query_id", contract.json_violations(F.element_at(kinds, (F.col("query_id") % 7 + 1).cast("int"))).alias("problems"))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN conv_id % 2 = 0 THEN ['timeout', 'contract'] ELSE ['error'] END) AS kind FROM conversations) GROUP BY kind")
def failure_summary(spark, sf):
    failures = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("timeout: 8 s"), F.lit("contract: message"))).otherwise(F.array(F.lit("error: no answer")))
    return rerank.failure_summary(table(spark, sf, "conversations").select(F.explode(failures).alias("failure")))


# ---- evaluation -------------------------------------------------------------

#: Passages found in documents are the truth; queries without one can't be hit.
OUTCOME = f"""{S.BASE}, {S.LEXICAL}, {S.PHRASE}, t AS ({TOP.format(rows='lexical')}), best AS (SELECT query_id, min(rank) AS best_rank FROM t SEMI JOIN evidence USING (query_id, doc_id) GROUP BY query_id),
o AS (SELECT item_id AS query_id, best_rank IS NOT NULL AS hit, best_rank, round(coalesce(1 / best_rank::DOUBLE, 0), 6) AS reciprocal_rank,
  CASE WHEN item_id % 10 < 4 THEN 'buying' WHEN item_id % 10 < 8 THEN 'browsing' WHEN item_id % 10 < 9 THEN 'intent_override' ELSE 'boundary' END AS scenario_type,
  CASE WHEN best_rank IS NOT NULL THEN 1 + item_id % 10 END AS first_hit_turn FROM benchmark LEFT JOIN best ON item_id = query_id)"""
SUMMARY = "count(*) AS count, round(avg(hit::INT::DOUBLE), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)::DOUBLE), 6) AS mttc"


def session_outcomes(spark, sf) -> DataFrame:
    q, p = questions(spark, sf), Passages(spark, sf)
    truth = q.select("query_id").join(p.evidence().select("query_id", "doc_id"), "query_id", "left")
    rows = metrics.outcomes(top(p.lexical()), truth)
    tenth = F.col("query_id") % 10
    scenario = F.when(tenth < 4, "buying").when(tenth < 8, "browsing").when(tenth < 9, "intent_override").otherwise("boundary")
    return rows.withColumns({"scenario_type": scenario, "first_hit_turn": F.when(F.col("hit"), 1 + tenth)})


@query(f"WITH {OUTCOME} SELECT * REPLACE (best_rank::DOUBLE AS best_rank, first_hit_turn::DOUBLE AS first_hit_turn) FROM o")
def session_metrics(spark, sf):
    return session_outcomes(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("best_rank", "first_hit_turn")})


@query(f"WITH {OUTCOME} SELECT scenario_type, {SUMMARY} FROM o GROUP BY ROLLUP (scenario_type)")
def scenario_metrics(spark, sf):
    return metrics.by_scenario(session_outcomes(spark, sf))


@query(f"""WITH {OUTCOME}, m AS (SELECT {SUMMARY} FROM o), e AS (SELECT *, least(greatest((11 - mttc) / 10, 0), 1) AS eff FROM m)
SELECT count, hit_rate, mrr, mttc, round(eff, 6) AS efficiency, round(0.5::DOUBLE * hit_rate + 0.3::DOUBLE * mrr + 0.2::DOUBLE * eff, 6) AS technical_score FROM e""")
def composite(spark, sf):
    return metrics.composite(metrics.summary(session_outcomes(spark, sf)))


@query("SELECT coalesce(sum(CASE WHEN conv_id % 5 - 1 >= 0 THEN conv_id % 5 - 1 END), 0)::BIGINT AS prompt_tokens, coalesce(sum(turn), 0)::BIGINT AS completion_tokens FROM conversations")
def token_usage(spark, sf):
    return metrics.token_usage(table(spark, sf, "conversations").select((F.col("conv_id") % 5 - 1).alias("prompt_tokens"), F.col("turn").alias("completion_tokens")))


@query("SELECT event_type AS scenario_type, event_id AS sample_id, CASE WHEN (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS half FROM events")
def stratified_split(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("scenario_type"), F.col("event_id").alias("sample_id"))
    return metrics.stratified_split(e)


WEIGHT_GRID = [(p, c) for p in (0.4, 1.0, 2.0) for c in (0.2, 0.4, 0.7)]
GRID = ", ".join(f"('phrase={p} category={c}', {p}::DOUBLE, {c}::DOUBLE)" for p, c in WEIGHT_GRID)


@query(f"""WITH {S.BASE}, {RRF}, g(config, pw, cw) AS (VALUES {GRID}),
f AS (SELECT config, query_id, doc_id, round(sum(CASE WHEN signal > 0 THEN CASE ranker WHEN 'phrase' THEN pw WHEN 'category' THEN cw ELSE 1.0::DOUBLE END / (60::DOUBLE + r) ELSE 0 END), 12) AS score FROM ranked, g GROUP BY ALL),
t AS (SELECT config, query_id, doc_id, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10),
h AS (SELECT config, query_id, min(rank) AS best FROM t SEMI JOIN (SELECT query_id, doc_id FROM evidence) USING (query_id, doc_id) GROUP BY ALL),
m AS (SELECT item_id % 2 AS fold, g.config AS config, round(avg(coalesce(1 / best::DOUBLE, 0)), 6) AS score FROM benchmark CROSS JOIN g LEFT JOIN h ON h.query_id = item_id AND h.config = g.config GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, config) AS rank FROM m)
SELECT fold, arg_min(config, rank) AS best_config, max(score) AS best, min(score) AS worst, round(max(score) - min(score), 6) AS spread, min(CASE WHEN config = 'phrase=1.0 category=0.4' THEN rank END) AS shipped_rank FROM r GROUP BY fold""")
def grid_summary(spark, sf):
    """Mean reciprocal rank of passages in two folds for nine pairs of fusion weights, from one ranking."""
    points = {f"phrase={a} category={b}": fusion.WEIGHTS | {"phrase": a, "category": b} for a, b in WEIGHT_GRID}
    tops, truth = fused(spark, sf, points, K)
    tops = stored(tops.withColumnRenamed("point", "config"), "tops")
    grid = F.broadcast(spark.createDataFrame([(name,) for name in points], "config string"))  # nine rows
    best = tops.join(truth, ["query_id", "doc_id"], "left_semi").groupBy("config", "query_id").agg(F.min("rank").alias("best"))
    every = questions(spark, sf).select("query_id").crossJoin(grid)
    score = F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6)
    runs = every.join(best, ["config", "query_id"], "left").groupBy((F.col("query_id") % 2).alias("fold"), "config").agg(score.alias("score"))
    return metrics.grid_summary(runs, F.col("config") == "phrase=1.0 category=0.4")


# ---- simulator --------------------------------------------------------------


def cards(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Parts as products with features, details and text, and their intent cards."""
    p = spread(products(spark, sf)).withColumns({
        "features": F.array(F.element_at("path", 1), "store"), "details": F.create_map(F.lit("size"), F.col("size").cast("string")),
        "text": F.concat_ws(" ", "title", "categories", "store"),
    })
    return p, simulate.intent_cards(p)


CARD = """card AS (SELECT p_partkey AS doc_id, p_type || ' ' || p_brand AS category, nullif(regexp_extract(lower(p_name), '\\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange)\\b', 1), '') AS color,
  [p_type, p_brand, 'size: ' || p_size] AS base, 'budget around $' || p_retailprice AS price FROM part),
every AS (SELECT doc_id, category, list_concat(CASE WHEN color IS NULL THEN base ELSE list_concat(base[1:1], ['color: ' || color], base[2:]) END, [price]) AS v FROM card)"""


@query(f"WITH {CARD} SELECT doc_id, category, v[1:2] AS hard, v[3:4] AS soft FROM every")
def intent_cards(spark, sf):
    return cards(spark, sf)[1]


def samples(spark, sf) -> DataFrame:
    """One sample per part: 40 % buying, 40 % browsing, 15 % override, 5 % boundary."""
    k = F.col("doc_id") % 20
    scenario = F.when(k < 8, "buying").when(k < 16, "browsing").when(k < 19, "intent_override").otherwise("boundary")
    return products(spark, sf).select(F.concat(F.lit("sample_"), F.col("doc_id").cast("string")).alias("sample_id"), scenario.alias("scenario_type"), F.col("doc_id").alias("target"))


@query(f"""WITH {CARD}, s AS (SELECT *, doc_id % 20 AS k FROM every) SELECT 'sample_' || doc_id AS sample_id, CASE WHEN k < 8 THEN 'I''m looking for ' || category || '. A key requirement is: ' || v[1] || '.'
  WHEN k < 16 OR k = 19 THEN 'I''m looking for ' || category || ', but I''m still exploring.' ELSE 'I''m looking for ' || category || '. ' || v[4] END AS opening,
  CASE WHEN k = 19 THEN 'I don''t have a preference for other; please use your judgment.' WHEN k < 8 THEN 'For that, what matters is: ' || v[2] || '; ' || v[3] || '.' ELSE 'For that, what matters is: ' || v[1] || '; ' || v[2] || '.' END AS answer FROM s""")
def simulator_replies(spark, sf):
    p, c = cards(spark, sf)
    rows = simulate.opened(simulate.hidden(samples(spark, sf), c), "clean")
    rows = rows.withColumn("opening", F.col("message"))
    return simulate.replied(rows, 1, "clean", F.lit("other")).select("sample_id", "opening", F.col("message").alias("answer"))


@query()
def paraphrase(spark, sf):
    c = table(spark, sf, "conversations")
    seed = X.seed16(F.concat_ws("_", F.lit("sample"), "conv_id"))
    return c.select("conv_id", "turn", simulate.paraphrase(F.col("text"), seed, 0.25).alias("text"))


@query()
def evaluate_loop(spark, sf):
    p, c = cards(spark, sf)
    return simulate.evaluate(samples(spark, sf), p, c)


@query()
def holdout_grid(spark, sf):
    """All 54 points of the grid on both halves of the samples, through the whole search."""
    p, c = cards(spark, sf)
    return simulate.holdout(samples(spark, sf), p, c)


@query()
def integrated_runs(spark, sf):
    """The evaluation with the gate off, as shipped, asking for missing slots, and with stand-ins for a model."""
    p, c = cards(spark, sf)
    on = search.Config()
    runs = {"gate off": (search.Config(hold=False), None), "shipped": (on, None), "clarify": (search.Config(clarify=True), None), **{m: (on, rerank.stub(m)) for m in ("reverse", "shuffle")}}
    return simulate.integrated(samples(spark, sf), p, c, runs)


# ---- profiling --------------------------------------------------------------


@query("""WITH n AS (SELECT count(*) AS n, count(doc_id) AS a, count(CASE WHEN text <> '' THEN 1 END) AS b, count(CASE WHEN lang <> '' THEN 1 END) AS c, count(CASE WHEN source <> '' THEN 1 END) AS d, count(n_chars) AS e FROM documents)
SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field, unnest([a, b, c, d, e]) AS filled, round(unnest([a, b, c, d, e]) / n::DOUBLE, 6) AS share FROM n""")
def field_completeness(spark, sf):
    return profile.completeness(table(spark, sf, "documents"))


@query("SELECT key, count(*) AS n FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def detail_keys(spark, sf):
    return profile.detail_keys(table(spark, sf, "events"), "props")


@query("SELECT p_brand AS leaf, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, leaf LIMIT 20")
def leaf_counts(spark, sf):
    return profile.leaf_counts(products(spark, sf))


@query("SELECT source AS department, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def department_counts(spark, sf):
    return profile.department_counts(documents(spark, sf))


@query("WITH l AS (SELECT lang || '/' || source || '/' || doc_id % 7 AS leaf, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS n_leaves, count(CASE WHEN n < 30 THEN 1 END) AS n_thin, coalesce(sum(CASE WHEN n < 30 THEN n END), 0)::BIGINT AS docs_affected FROM l")
def thin_leaves(spark, sf):
    docs = documents(spark, sf).select(F.array(F.concat_ws("/", "lang", "source", (F.col("doc_id") % 7).cast("string"))).alias("path"))
    return profile.thin_leaves(docs)


@query()
def hash_seeds(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.seed16(F.concat_ws("_", F.lit("sample"), "conv_id", "turn")).alias("seed"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf):
    from ..streaming.session_stream import windowed_counts

    out = windowed_counts(table(spark, sf, "events"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package's sources sent to the executors first."""

    @wraps(f)
    def run(spark, sf):
        ship(spark)
        return f(spark, sf)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
