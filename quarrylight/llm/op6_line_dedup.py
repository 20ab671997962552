"""Line dedup with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed; the hashes are
counted by distinct document; positions of lines over the threshold are sent
back to their document, which is put together again from the positions left.
Only hashes, ids and positions are shuffled for counting.  A line that a third
of all documents hold is combined before the shuffle, and where its hash meets
the rows that hold it, adaptive execution splits that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, WS, columns, scan, stored, text_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z as a-z, other letters as they are."""
    key = F.btrim(line, F.lit(WS))
    ascii_only = F.octet_length(key) == F.char_length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, UPPER.lower()))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents hold, but for the first document's.

    Returns doc_id, n_lines, n_dropped and the text kept, one row per input row.

    A null or empty text has one empty line and stays empty.  Keys below
    ``min_chars`` code points never go.  A line repeated within one document
    counts for one document; all its copies stay in the smallest id and go in
    the others.  Rows with the same id count as one document.  A null id ranks
    after all others.  Two 64-bit hashes with different seeds stand for a key.
    Other columns of the input are ignored, so their names can't clash.
    """
    docs = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_of().alias("text"))
    docs = docs.withColumns({"rank": F.coalesce("doc_id", F.lit(LAST_ID)), "same": F.xxhash64("text")})
    lines = docs.select("rank", "same", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("rank", "same", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.char_length("key") >= min_chars)
    lines = lines.select("rank", "same", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    held = lines.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    if min_docs <= 2:
        held = held.filter(F.col("first") != F.col("last") if min_docs == 2 else F.lit(True))
    else:
        counts = lines.select("h1", "h2", "rank").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
        held = counts.filter(F.col("n") >= min_docs)
    # Stored, it is one side of a plain join, whose other side's hot hashes adaptive execution can split.
    held = stored(held.select("h1", "h2", "first"), "lines-held")
    gone = lines.join(held, ["h1", "h2"]).filter(F.col("rank") != F.col("first"))
    gone = gone.groupBy("rank", "same").agg(F.collect_set("pos").alias("gone"))
    out = docs.join(gone, ["rank", "same"], "left")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    out = out.select("doc_id", "text", "gone", parts.alias("parts"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    return out.select(
        "doc_id",
        F.size("parts").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        kept.alias("text"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(scan(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, h.first IS NOT NULL AND h.first <> k.doc_id AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
