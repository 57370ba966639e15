"""Held-out passages that leak into documents: latent semantic retrieval with an exact check.

1. One pass over all documents turns each text into words as a reader sees them and keeps the stretches that
   are dense in words of the passages, as sequences of word numbers (-1 for a word of no passage or answer). A window with
   fewer such words than a case needs cannot hold one, so nothing is lost. The same pass counts for each word of the
   passages the documents that have it.
2. Windows of passages and of the kept stretches are sparse TF-IDF rows. Their leading right singular vectors come
   from a randomised SVD whose products with the matrix are summed over partitions (``latent_basis``).
3. Each window of a stretch is compared by cosine in the latent space with all windows of the passages, held
   in blocks, and leaves the passages of sufficiently similar windows as candidates (``candidates``). Nothing else makes a
   candidate.
4. A candidate is confirmed by its longest run of common words, or else by the least number of replaced,
   dropped and added words over any part of the passage that is long enough; the longest common subsequence
   and whether the answer follows in the same stretch are reported with it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm import words
from pointspark.session import cut

RUN = 12  # consecutive words that make a case
LONG, EDITS = 30, 8  # or so many words in order, one in EDITS of them changed
WINDOW, STRIDE = 24, 12
MIN_KNOWN = 12  # words of the passages that a window must have
RANK = 128
COSINE = 0.55
SHORTEST = 5  # with one word in EDITS changed, so many words somewhere stay together
#: The items are the stated query set, held by every task: so many at a time.
BLOCK_ITEMS = 2_000

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[^\w\n]*(?=[^\W\d_])")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|code|span|tt|mark|sub|sup|a|font|kbd|small|big)\b[^<>\n]{0,200}>", re.I)
_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|th|table|h[1-6]|pre|hr|blockquote)\b[^<>\n]{0,200}>", re.I)
_CONTROL = re.compile(r"\\[nrt]")
_LINK = re.compile(r"\]\([^()\s]*\)")
_SLOW = re.compile(rb"[\x80-\xff]|[A-Za-z]-[ \t]*\r?\n|\\[nrtu]|&#?\w{1,8};|</?[A-Za-z][A-Za-z1-6]{0,9}[ />]|\]\(")


def as_read(text: str) -> bytes:
    """The words of a text as a reader sees them, in lower case, joined by blanks."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _CONTROL.sub(" ", _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return words.lowered(_BROKEN.sub("", text))


def _needs_reading(t: bytes) -> bool:
    return _SLOW.search(t) is not None


class Passages:
    """The words of a block of items, and the windows of their passages."""

    def __init__(self, items: list):
        texts = [as_read(r["passage"] or "") for r in items]
        h, begins = words.hashed(texts)
        answers, a_begins = words.hashed([as_read(r["answer"] or "") for r in items])
        self.item_id = np.array([r["item_id"] for r in items], np.int64)
        self.vocabulary = np.unique(np.r_[h, answers])
        ids, answers = np.searchsorted(self.vocabulary, h), np.searchsorted(self.vocabulary, answers)
        self.counts = np.zeros(len(self.vocabulary), bool)  # words of answers only are told apart, but do not count
        self.counts[ids] = True
        self.ids = [ids[begins[k] : begins[k + 1]] for k in range(len(items))]
        self.answers = [answers[a_begins[k] : a_begins[k + 1]] for k in range(len(items))]
        at, rows = [], []
        for k, p in enumerate(self.ids):
            for s in sorted({*range(0, max(1, len(p) - WINDOW + 1), STRIDE // 2), max(0, len(p) - WINDOW)}):
                rows.append(p[s : s + WINDOW])
                at.append(k)
        self.window_item, self.windows = np.array(at, np.int64), rows


def _known(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == h, at, -1).astype(np.int32)


def _stretches(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, at, words) for dense stretches; at the end one row without doc_id, the counts of documents."""
    seen = np.zeros(len(vocabulary), np.int64)
    docs = 0
    names = ["doc_id", "at", "words"]
    for b in batches:
        doc_ids = b.column(0).to_numpy(zero_copy_only=False)
        out: list[tuple[int, int, np.ndarray]] = []
        for first, texts in words.chunks(b.column(1), _needs_reading, as_read):
            h, begins = words.hashed(texts)
            ids = _known(h, vocabulary)
            doc = np.repeat(np.arange(len(texts)), np.diff(begins))
            hit = (ids >= 0) & counts[ids]
            pairs = np.unique(doc[hit] * len(vocabulary) + ids[hit])
            seen += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            docs += len(texts)
            # windows of each text at multiples of the stride
            n_words = np.diff(begins)
            many = np.maximum(1, -(-np.maximum(0, n_words - WINDOW) // STRIDE) + 1)
            many[n_words == 0] = 0
            w_doc = np.repeat(np.arange(len(texts)), many)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = begins[w_doc] + k * STRIDE
            end = np.minimum(start + WINDOW, begins[w_doc + 1])
            c = np.r_[0, np.cumsum(hit)]
            dense = np.flatnonzero(c[end] - c[start] >= MIN_KNOWN)
            if not len(dense):
                continue
            # dense windows that touch make one stretch, with a window's words on both sides
            lo = np.maximum(start[dense] - WINDOW, begins[w_doc[dense]])
            hi = np.minimum(end[dense] + WINDOW, begins[w_doc[dense] + 1])
            new = np.flatnonzero(np.r_[True, (w_doc[dense][1:] != w_doc[dense][:-1]) | (lo[1:] > hi[:-1])])
            last = np.r_[new[1:], len(dense)] - 1
            for f, g in zip(new, last, strict=True):
                d = w_doc[dense[f]]
                out.append((doc_ids[first + d], int(lo[f] - begins[d]), ids[lo[f] : hi[g]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([int(o[0]) for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int32()), pa.array([seen.astype(np.int32)], pa.list_(pa.int32()))], names=names)


def _begins(n: int) -> list[int]:
    """Where the windows of n words begin: every half stride, and the last."""
    return sorted({*range(0, max(1, n - WINDOW + 1), STRIDE // 2), max(0, n - WINDOW)})


def _windows_of(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[s : s + WINDOW] for s in _begins(len(ids))]


class Rows:
    """TF-IDF rows of unit length in sparse form; words without weight are left out."""

    def __init__(self, rows: list[np.ndarray], idf: np.ndarray):
        n = np.fromiter((len(r) for r in rows), np.int64, len(rows))
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), n)
        ok = (flat >= 0) & (idf[flat] > 0)
        key, count = np.unique(row[ok] * len(idf) + flat[ok], return_counts=True)
        self.n, self.row, self.term = len(rows), key // len(idf), key % len(idf)
        v = np.log1p(count) * idf[self.term]
        self.v = v / np.sqrt(np.maximum(np.bincount(self.row, v * v, self.n), 1e-24))[self.row]

    def times(self, q: np.ndarray) -> np.ndarray:
        """A q."""
        out = np.zeros((self.n, q.shape[1]), q.dtype)
        if len(self.row):
            first = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
            out[self.row[first]] = np.add.reduceat(q[self.term] * self.v[:, None].astype(q.dtype), first, axis=0)
        return out

    def back(self, y: np.ndarray, out: np.ndarray) -> None:
        """Add the transposed A times y to out."""
        if len(self.row):
            o = np.argsort(self.term, kind="stable")
            t = self.term[o]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            out[t[first]] += np.add.reduceat(y[self.row[o]] * self.v[o, None], first, axis=0)


def _many(rows: Iterator[np.ndarray], most: int = 512) -> Iterator[list[np.ndarray]]:
    """Windows, ``most`` at a time, however many a stretch has."""
    held: list[np.ndarray] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def latent_basis(stretches: DataFrame, passages: Passages, idf: np.ndarray, rank: int = RANK, power: int = 2) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF rows of all windows, by a distributed randomised SVD.

    Each partition multiplies its rows A by the small matrix Q and returns AᵀAQ (words of the passages by rank,
    bounded by the query set); sums are formed on a few tasks, and only they reach the driver.
    """
    n_terms = len(idf)
    width = min(n_terms, rank + 8)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((n_terms, width)))[0]
    own = [Rows(w, idf) for w in _many(iter(passages.windows))]

    def product(q: np.ndarray) -> np.ndarray:
        def part(it):
            s = np.zeros((n_terms, width))
            for w in _many(w for b in it for r in b["words"] for w in _windows_of(np.asarray(r))):
                a = Rows(w, idf)
                a.back(a.times(q), s)
            yield pd.DataFrame({"s": [s.tobytes()]})

        def total(it):
            s = np.zeros(n_terms * width)
            for b in it:
                for x in b["s"]:
                    s += np.frombuffer(x)
            yield pd.DataFrame({"s": [s.tobytes()]})

        parts = stretches.select("words").mapInPandas(part, "s binary").repartition(4).mapInPandas(total, "s binary").collect()
        s = np.zeros((n_terms, width))
        for a in own:
            a.back(a.times(q), s)
        for r in parts:
            s = s + np.frombuffer(r["s"]).reshape(n_terms, width)
        return s

    for _ in range(power):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    return (q @ vectors[:, ::-1])[:, : min(rank, width)]


def _longest_run(same: np.ndarray) -> int:
    """Longest diagonal run of a match matrix."""
    i, j = np.nonzero(same)
    if not len(i):
        return 0
    o = np.lexsort((i, i - j))
    d, i = (i - j)[o], i[o]
    cut_ = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1), True])
    return int(np.diff(cut_).max())


def _near_copy(p: np.ndarray, t: np.ndarray) -> bool:
    """Whether LONG or more words of the passage, in order, come in the text with at most one in EDITS changed.

    For every first word of the passage at once, the least number of edits (replaced, dropped, added words) up to
    each further word, ended at any place of the text.
    """
    n = len(p) - LONG + 1
    if n <= 0:
        return False
    m = len(t)
    at = np.arange(m + 1, dtype=np.int16)
    row = np.zeros((n, m + 1), np.int16)
    for k in range(len(p)):
        live = min(n, len(p) - k)  # starts that still have a word at this length
        row = row[:live]
        word = p[k : k + live]
        nxt = np.empty_like(row)
        nxt[:, 0] = k + 1
        np.minimum(row[:, :-1] + (t[None, :] != word[:, None]), row[:, 1:] + 1, out=nxt[:, 1:])
        row = np.minimum.accumulate(nxt - at, axis=1) + at
        length = k + 1
        best = row.min()
        if length >= LONG and best * EDITS <= length:
            return True
        if best * EDITS > len(p):
            return False
    return False


def _lcs(p: np.ndarray, t: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(t) + 1, np.int32)
    for w in p:
        row[1:] = np.maximum.accumulate(np.where(t == w, row[:-1] + 1, row[1:]))
    return int(row[-1])


def _confirmed(ids: np.ndarray, hits: dict[int, list[int]], passages: Passages) -> list[tuple[int, int, int]]:
    """Of the candidate items of a stretch those that leak: (item, longest run, longest common subsequence)."""
    out = []
    for k, starts in hits.items():
        p = passages.ids[k]
        lo = max(0, min(starts) - len(p) - WINDOW)
        hi = max(starts) + WINDOW + len(p) + WINDOW
        t = ids[lo:hi]
        same = p[:, None] == t[None, :]
        run = _longest_run(same)
        if run >= RUN or (run >= SHORTEST and _near_copy(p, t)):
            out.append((k, run, _lcs(p, t)))
    return out


def _has_run(ids: np.ndarray, run: np.ndarray) -> bool:
    """Whether the words of the run come one after the other."""
    n = len(ids) - len(run) + 1
    if not len(run) or n <= 0:
        return False
    ok = np.ones(n, bool)
    for k, w in enumerate(run):
        ok &= ids[k : k + n] == w
    return bool(ok.any())


def _retrieved(batches: Iterator[pd.DataFrame], passages: Passages, idf: np.ndarray, basis: np.ndarray, cosine: float, check: bool) -> Iterator[pd.DataFrame]:
    """Candidates of each stretch by cosine in the latent space; with ``check`` those of them that leak."""
    small = basis.astype(np.float32)

    def unit(rows):
        a = Rows(rows, idf).times(small)
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)

    target = np.concatenate([unit(w) for w in _many(iter(passages.windows))])
    item = passages.window_item
    for b in batches:
        rows = []
        for doc_id, ids in zip(b["doc_id"], b["words"], strict=True):
            ids = np.asarray(ids)
            starts = _begins(len(ids))
            hits: dict[int, list[int]] = {}
            best: dict[int, float] = {}
            for c, w in enumerate(_many(ids[s : s + WINDOW] for s in starts)):
                like = unit(w) @ target.T
                i, j = np.nonzero(like >= cosine)
                for s, k, v in zip(i.tolist(), item[j].tolist(), like[i, j].tolist(), strict=True):
                    hits.setdefault(k, []).append(starts[512 * c + s])
                    best[k] = max(best.get(k, -1.0), v)
            if not check:
                rows += [(doc_id, passages.item_id[k], v, 0, 0, False) for k, v in best.items()]
                continue
            rows += [(doc_id, passages.item_id[k], best[k], run, lcs, _has_run(ids, passages.answers[k])) for k, run, lcs in _confirmed(ids, hits, passages)]
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "run", "lcs", "answer"])


def leaks(documents: DataFrame, items: DataFrame, cosine: float = COSINE, rank: int = RANK, check: bool = True) -> DataFrame:
    """``(doc_id, item_id, cosine, run, lcs, answer)``: the items that each document gives away.

    A case has RUN consecutive words of the passage, or LONG or more in order of which at most one in EDITS is
    replaced, dropped or followed by an added word. ``run`` and ``lcs`` are the longest run and subsequence of the
    passage's words in the document's best stretch, ``answer`` tells whether the words of the answer come one after the
    other in a stretch that gives the item away. With ``check=False`` the candidates of the latent search come out unconfirmed. Null or wordless texts and
    passages, and null ids, give no cases; copies of a document each have their own; extra columns are ignored.
    Items are the stated query set: they are read to the driver in blocks of BLOCK_ITEMS, every document is
    compared with every block.
    """
    spark = documents.sparkSession
    wanted = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).groupBy("item_id").agg(F.min(F.struct("passage", "answer")).alias("s"))
    wanted = wanted.select("item_id", "s.passage", "s.answer").orderBy("item_id")
    schema = "doc_id long, item_id long, cosine double, run int, lcs int, answer boolean"
    result, after = None, None
    while True:
        rows = (wanted if after is None else wanted.where(F.col("item_id") > after)).limit(BLOCK_ITEMS).collect()
        if not rows:
            break
        after = rows[-1]["item_id"]
        passages = Passages(rows)
        if not len(passages.vocabulary):
            continue
        found = _block(documents, passages, cosine, rank, check, schema)
        result = found if result is None else result.union(found)
    if result is None:
        return spark.createDataFrame([], schema)
    return result.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("run").alias("run"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def _block(documents: DataFrame, passages: Passages, cosine: float, rank: int, check: bool, schema: str) -> DataFrame:
    d = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    vocabulary, in_passage = passages.vocabulary, passages.counts
    kept = cut(d.mapInArrow(lambda it: _stretches(it, vocabulary, in_passage), "doc_id long, at int, words array<int>"))
    # documents by word: summed word by word, one row a partition
    counts = kept.where("doc_id IS NULL").select("at", F.posexplode("words").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    n_docs = kept.where("doc_id IS NULL").agg(F.sum("at")).first()[0] or 0
    df = np.zeros(len(vocabulary))
    for r in counts:
        df[r["term"]] = r["n"]
    idf = np.where(in_passage, np.log((1 + n_docs) / (1 + df)) + 0.1, 0.0)
    stretches = kept.where("doc_id IS NOT NULL")
    basis = latent_basis(stretches, passages, idf, rank)
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stretches.repartition(n, "doc_id", "at").mapInPandas(lambda it: _retrieved(it, passages, idf, basis, cosine, check), schema)
