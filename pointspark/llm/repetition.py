"""Repetition inside a document, and lines that recur across documents.

``line_frequency`` is the cross-document method: normalised lines are hashed, the distinct documents of a
host (repository) that hold a line are counted, lines above a limit are removed, and documents of which
too little is left are rejected. It finds what documents share with each other, but cannot see a phrase
that one document repeats within a line, nor one that no other document has. The share of repeated
content of each document is therefore measured by ``repeated_share``, which hashes every window of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm import words
from pointspark.session import cut

WINDOW = 8
_WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def _repeated(h: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """For each text, how many of its words lie in a window that also begins earlier in the text."""
    n = len(h) - window + 1
    count = np.zeros(len(begins) - 1, np.int64)
    if n <= 0:
        return count
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key += h[k : k + n] * _WEIGHTS[k]
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(at):
        return count
    key = words.mixed(key[at] + doc[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    o = np.argsort(key, kind="stable")
    again = np.zeros(len(at), bool)
    again[o[1:]] = key[o][1:] == key[o][:-1]
    at = at[again]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=len(count))


def _shares(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, repeated = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        for first, texts in words.chunks(b.column(1), lambda t: not t.isascii(), words.lowered):
            h, begins = words.hashed(texts)
            total[first : first + len(texts)] = np.diff(begins)
            repeated[first : first + len(texts)] = _repeated(h, begins, window)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(repeated)], names=["doc_id", "n_words", "n_repeated"])


def repeated_share(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_repeated, share)``, one row a document.

    A word is repeated if it lies in ``window`` consecutive words that also begin earlier in the document;
    words are runs of letters, case ignored. A null or wordless text has share 0. Documents are handled one
    by one, so there is no shuffle and no group; rows without doc_id are left out, further columns ignored.
    """
    d = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    out = d.mapInArrow(lambda it: _shares(it, window), "doc_id long, n_words long, n_repeated long")
    return out.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(0.0))


def line_frequency(documents: DataFrame, host: str = "repo", limit: int = 10, keep: float = 0.5, min_chars: int = 1) -> DataFrame:
    """Cross-document line frequency: ``(doc_id, n_lines, n_removed, kept_share, depleted, kept_text)``.

    A line is normalised (lower case, digits as 0, runs of blanks as one, ends trimmed) and counts if at least
    ``min_chars`` are left, so by default all but blank lines do. Lines that more than ``limit`` distinct documents of
    one host hold are removed; a document is depleted if less than ``keep`` of its counted lines remain. ``kept_text``
    is the text without the removed lines, the others as they were, with their line ends. A null host is a host of its
    own; documents without lines have share 1. Counts are pre-aggregated on (host, line), so a hot host is spread over
    its lines and a hot line is one partial count a task.
    """
    h = F.coalesce(F.col(host).cast("string"), F.lit("\u0000"))
    split = F.regexp_extract_all("text", F.lit("([^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+)"), F.lit(1))  # with line ends
    norm = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"\d", "0"), r"\s+", " "))
    # a line that does not count has no hash
    hashes = F.transform(F.transform(split, norm), lambda s: F.when(F.length(s) >= min_chars, F.xxhash64(h, s)))
    lines = F.coalesce(F.filter(hashes, lambda x: x.isNotNull()), F.array().cast("array<bigint>"))
    known = documents.where(F.col("doc_id").isNotNull())
    d = cut(known.select("doc_id", lines.alias("lines")))
    often = (
        d.select(F.explode(F.array_distinct("lines")).alias("line")).groupBy("line").count().where(F.col("count") > limit).select("line")
    )
    counted = d.select("doc_id", F.explode("lines").alias("line")).groupBy("doc_id", "line").count()
    gone = counted.join(often, "line", "left_semi").groupBy("doc_id").agg(F.sum("count").alias("n_removed"), F.collect_set("line").alias("gone"))
    # texts are read again and hashed again where lines go, as texts and hashes together would double what is written
    texts = known.select("doc_id", "text", F.col(host).alias(host), F.size(lines).cast("long").alias("n_lines"))
    out = texts.join(gone, "doc_id", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    stays = F.filter(F.arrays_zip(split.alias("s"), hashes.alias("h")), lambda x: x["h"].isNull() | ~F.array_contains("gone", x["h"]))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda x: x["s"]), ""))
    out = out.select("doc_id", "n_lines", "n_removed", kept.alias("kept_text"))
    share = F.when(F.col("n_lines") > 0, 1 - F.col("n_removed") / F.col("n_lines")).otherwise(1.0)
    return out.select("doc_id", "n_lines", "n_removed", share.alias("kept_share"), (share < keep).alias("depleted"), "kept_text")
