"""Quality rules: base counts, and repetition measured by suffix arrays.

The words of a whole text are its symbols.  A suffix array is built by prefix
doubling for all texts of an Arrow batch at once (a word's first rank holds its
text's number, so no repeat spans two texts); only suffixes still tied are
sorted again.  Ranks of every level answer longest-common-prefix queries of
neighbours by binary descent.  The LCP interval right above a suffix is the
longest repeat that starts there, so those spans together cover the same words
as all maximal repeated substrings; a text is rejected when they cover too
large a share of it or when one of them is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded, give_back, pieces, scan, whole_row

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW_LEVEL = 3  # 2**3 = 8 words, the window of n_repeat_words
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_SPAN = 10  # words of the shortest repeat that counts
MAX_COVERED = 0.3  # share of the words that repeats may cover
MAX_LONGEST = 100  # words of the longest repeat allowed

FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()),
]


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """ranks[k][p]: dense-enough rank of the 2**k symbols from p on, ties meaning equality.

    ``ends[p]`` is where p's text ends.  A rank is one more than the number of
    suffixes in smaller groups; 0 stands for what lies beyond the end.  The
    last level has no ties, so it is the inverse suffix array.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int32 if n < 2**31 - 1 else np.int64)
    rank[order] = start + 1
    ranks, width = [rank], 1
    tied = ~head
    tied[:-1] |= ~head[1:]
    active = order[tied]
    while len(active) or len(ranks) <= WINDOW_LEVEL:
        rank = rank.copy()
        if len(active):
            nxt = active + width
            inside = nxt < ends[active]
            second = np.where(inside, ranks[-1][np.minimum(nxt, n - 1)], 0)
            first = ranks[-1][active]
            by = np.lexsort((second, first))
            active, first, second = active[by], first[by], second[by]
            at = np.arange(len(active))
            group = np.ones(len(active), bool)
            group[1:] = first[1:] != first[:-1]
            part = group.copy()
            part[1:] |= second[1:] != second[:-1]
            base = np.maximum.accumulate(np.where(group, at, 0))
            own = np.maximum.accumulate(np.where(part, at, 0))
            rank[active] = first + (own - base)
            tied = ~part
            tied[:-1] |= ~part[1:]
            active = active[tied]
        ranks.append(rank)
        width *= 2
    return ranks


def covered(spans: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans, 1)
    np.add.at(edge, spans + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(ranks: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """For each suffix the length of its parent LCP interval, 0 below 8 symbols."""
    n = len(doc)
    sa = np.empty(n, np.int64)
    sa[ranks[-1] - 1] = np.arange(n)
    window = ranks[WINDOW_LEVEL]
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(window[a] == window[b])
    i, j = a[near].copy(), b[near].copy()
    lcp = np.zeros(len(near), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        # j or i may stand at n after a step that ended a text; a text's end never ties.
        ok = (i < n) & (j < n)
        same = np.zeros(len(near), bool)
        same[ok] = (ranks[level][i[ok]] == ranks[level][j[ok]]) & (doc[i[ok]] == doc[a[near][ok]]) & (doc[j[ok]] == doc[a[near][ok]])
        lcp[same] += 1 << level
        i[same] += 1 << level
        j[same] += 1 << level
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a[near], lcp)
    np.maximum.at(longest, b[near], lcp)
    return longest


def measure(texts: list[str | None], min_span: int = MIN_SPAN) -> list[np.ndarray]:
    """The columns of FIELDS for some texts."""
    out = np.zeros((len(FIELDS), len(texts)), np.int64)
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        own = raw.split()
        counts[d] = len(own)
        words += own
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        out[1:4, d] = (
            len(text) - (len(raw) - len(raw.translate(None, SPACE))),
            len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)),
        )
    out[0] = counts
    n = len(words)
    if n:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        doc = np.repeat(np.arange(len(texts)), counts)
        ends = np.repeat(np.cumsum(counts), counts)
        symbols = doc * len(number) + np.fromiter(map(number.__getitem__, words), np.int64, n)
        ranks = suffix_ranks(symbols, ends)
        window = ranks[WINDOW_LEVEL]
        again = np.flatnonzero(np.bincount(window)[window] > 1)
        out[4] = np.bincount(doc[covered(again, np.full(len(again), 8), n)], minlength=len(texts))
        longest = repeats(ranks, doc)
        at = np.flatnonzero(longest >= min_span)
        out[5] = np.bincount(doc[covered(at, longest[at], n)], minlength=len(texts))
        np.maximum.at(out[6], doc[at], longest[at])
    return list(out)


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: the base counts, the repeats' figures and the verdict.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word
    windows found twice.  kept: not base_failed, the words covered by repeats of
    ``min_span`` words or more are at most ``max_covered`` of all, and the
    longest repeat has at most ``max_longest`` words.  A null or empty text has
    no words and fails.  Texts are never cut; one suffix array holds the
    whole texts of at most 256 rows and 4 MB, or of one longer row.  Other input columns are ignored; ``carry`` adds the
    whole input row as the struct ``row_``.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([whole_row(docs)] if carry else []))
    schema = rows.drop("text", "row_").withColumns({name: F.lit(0).cast("long") for name, _ in FIELDS})
    schema = schema.schema if not carry else StructType([*schema.schema.fields, rows.schema["row_"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            figures = [pa.array(x) for x in measure(b.column(1).to_pylist(), min_span)]
            yield pa.RecordBatch.from_arrays([b.column(0), *figures, *([b.column(2)] if carry else [])], names=schema.names)
        give_back()

    bounded(docs.sparkSession)
    out = rows.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def query(spark, sf_dir: str) -> DataFrame:
    return quality(scan(spark, sf_dir, "doc_id", "text"))


ORACLE = None  # suffix arrays: held against brute force in tests/llm
