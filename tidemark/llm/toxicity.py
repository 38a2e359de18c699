"""Toxicity by the nearest labelled examples under TF-IDF cosine.

``fit`` takes a bounded sample of labelled texts and indexes the examples of both labels
under all their words, in an inverted index of blocks. A term's weight is its TF-IDF, and
counts in full if its presence is associated with the label (chi-square with Yates'
correction; the bound on p allows for the number of terms tried), else by the share
OTHER. For each term and block the index holds the largest weight in that block. A query
adds those up to a bound for each block, looks into the blocks of the highest bounds,
and then into all those whose bound is not under the nearest found so far: the nearest
are exact. Votes are weighted by distance, and isotonic regression on the votes of labelled
rows that are no examples and chose no terms turns them into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts

TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


#: Bytes of a stem term: inflected forms of one stem are one more term, if that is associated with the label.
STEM = 5
#: Share of its TF-IDF weight that a term counts which is not associated with the label.
OTHER = 0.1
#: Blocks that are looked into before bounds are held against the nearest found.
FIRST_BLOCKS = 4


def term_counts(text: bytes) -> Counter:
    """Words of a text: letters, digits, all beyond ASCII; A-Z lower-cased."""
    return Counter(TERM.findall(text.lower()))


def with_stems(counts: Counter) -> Counter:
    """And the stems of longer words, marked by an asterisk."""
    out = Counter(counts)
    for word, n in counts.items():
        if len(word) > STEM:
            out[word[:STEM] + b"*"] += n
    return out


@dataclass
class ToxicityIndex:
    """An index of labelled examples: some 25 MB at the default bounds, 1 GB if all examples are as long as may be and share no word.

    ``at`` and ``weight`` are the postings by term, then example; those of a term in one
    block are an entry: from ``begin[e]`` to ``begin[e + 1]``, in block ``block_of[e]``,
    of largest weight ``block_max[e]``. Term t has the entries ``first[t]`` to ``first[t + 1]``.
    """

    terms: dict[bytes, int]
    stem_of: np.ndarray
    factor: np.ndarray
    keys: np.ndarray  # objects, as the table has them
    labels: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    begin: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray
    first: np.ndarray
    blocks: int
    block: int
    neighbours: int
    prior: float
    empty_score: float
    grid: np.ndarray
    scores: np.ndarray

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text (of its ``term_counts``) and their unit-length weights."""
        return _unit(self.terms, self.stem_of, self.factor, counts)

    def nearest(self, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples (cosine over 0) and their cosines; ties go to the lower position."""
        entry, q = _ranges(self.first[ids], self.first[ids + 1], weights)
        block = self.block_of[entry]
        bounds = np.bincount(block, self.block_max[entry] * q, minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        k, (near, rest) = self.neighbours, np.split(order, [FIRST_BLOCKS])
        sums = self._sums(near, entry, q, block)
        found = np.partition(sums, -k)[-k] if len(sums) > k else 0.0
        # Sums of floats may differ in the last bits: a block whose bound is equal but for those is looked into.
        rest = rest[(bounds[rest] > 0) & (bounds[rest] >= found * (1 - 1e-9))]
        if 3 * len(rest) > self.blocks:  # most of the index: whole postings of the terms are read faster
            place, w = _ranges(self.begin[self.first[ids]], self.begin[self.first[ids + 1]], weights)
            sums = np.bincount(self.at[place], self.weight[place] * w, minlength=len(sums))
        elif len(rest):
            sums += self._sums(rest, entry, q, block)
        there = np.flatnonzero(sums > 0)
        if len(there) > k:  # all that tie with the last one stay for the order
            there = there[sums[there] >= np.partition(sums[there], -k)[-k] * (1 - 1e-9)]
        top = there[np.lexsort((there, -np.round(sums[there], 9)))[:k]]
        return top, sums[top]

    def _sums(self, blocks: np.ndarray, entry: np.ndarray, q: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Cosines with the examples of some blocks, from the query's entries."""
        chosen = np.zeros(self.blocks, bool)
        chosen[blocks] = True
        mine = chosen[block]
        e = entry[mine]
        place, w = _ranges(self.begin[e], self.begin[e + 1], q[mine])
        return np.bincount(self.at[place], self.weight[place] * w, minlength=len(self.labels))

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Votes weighted by 1 / distance (of unit vectors), one vote of the prior added."""
        w = 1.0 / np.sqrt(np.maximum(2 - 2 * cosine, 0.0025))
        return float((w @ self.labels[at] + self.prior) / (w.sum() + 1))

    def score(self, counts: Counter) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability of label 1, and the examples it rests on with their cosines."""
        ids, weights = self.vector(counts)
        at, cosine = self.nearest(ids, weights) if len(ids) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(at):
            return self.empty_score, at, cosine
        return float(np.interp(self.vote(at, cosine), self.grid, self.scores)), at, cosine


def _ranges(first: np.ndarray, last: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [first, last), and for each the value of its range."""
    size = last - first
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0), np.repeat(value, size)


def _unit(terms: dict[bytes, int], stem_of: np.ndarray, factor: np.ndarray, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Known terms and weights; ``stem_of`` has the stem's term of each word that is a term, -1 for none."""
    known = terms.get
    ids, n = np.fromiter(map(known, counts, repeat(-1)), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
    there = ids >= 0
    stems = np.where(there, stem_of[ids], -1)
    if not there.all():  # words that no example has
        names = list(counts)
        for i in np.flatnonzero(~there).tolist():
            if len(names[i]) > STEM:
                stems[i] = known(names[i][:STEM] + b"*", -1)
    by_stem, of = np.unique(stems[stems >= 0], return_inverse=True)
    ids, n = np.concatenate([ids[there], by_stem]), np.concatenate([n[there], np.bincount(of, n[stems >= 0], minlength=len(by_stem))])
    order = np.argsort(ids)
    ids, n = ids[order], n[order]
    w = (1 + np.log(n)) * factor[ids]
    return ids, w / np.sqrt(w @ w) if len(w) else w


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of y on x (pool adjacent violators)."""
    value, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for v, s, n in zip(value.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        pools.append([s, n, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    points = sorted({(p[i], (p[0] + 0.5) / (p[1] + 1)) for p in pools for i in (2, 3)})
    return np.array([p[0] for p in points]), np.maximum.accumulate(np.array([p[1] for p in points]))


def fit(keys: list, examples: list[bytes], labels: list[int], neighbours: int = 15, block: int = 64, p: float = 0.01, calibrate: int = 5, other: float = OTHER) -> ToxicityIndex:
    """An index over the examples given (no examples: every score is 0.5).

    Every ``calibrate``-th row (0: none) is no example but serves to turn votes into
    probabilities. Examples without words count for the score of texts without known ones.
    """
    y = np.array(labels, np.float64)
    held = np.arange(calibrate - 1, len(y), calibrate) if calibrate else np.arange(0)
    mine = np.setdiff1d(np.arange(len(y)), held)
    n, ones = len(mine), float(y[mine].sum())
    counted = [term_counts(x) for x in examples]
    df, df1 = Counter(), Counter()
    for i in mine.tolist():
        own = with_stems(counted[i]).keys()
        df.update(own)
        if labels[i]:
            df1.update(own)
    tried = [t for t in df if df[t] >= 5]
    a = np.array([df1[t] for t in tried], np.float64)
    b = np.array([df[t] for t in tried], np.float64) - a
    chi = np.zeros(len(tried))
    if 0 < ones < n and tried:
        chi = n * np.maximum(0, np.abs(a * (n - ones - b) - b * (ones - a)) - n / 2) ** 2 / np.maximum(1, (a + b) * (n - a - b) * ones * (n - ones))
    # The chi-square (1 degree) whose tail is p / terms tried, from the normal tail's bound exp(-z*z/2).
    marks = {t for t, x in zip(tried, chi.tolist()) if x >= 2 * np.log(max(1, len(tried)) / p)}
    terms = {t: i for i, t in enumerate(sorted(t for t in df if t in marks or not t.endswith(b"*")))}
    factor = np.array([(np.log((1 + n) / (1 + df[t])) + 1) * (1 if t in marks else other) for t in terms])
    stem_of = np.array([terms.get(t[:STEM] + b"*", -1) if len(t) > STEM and not t.endswith(b"*") else -1 for t in terms] or [-1], np.int64)
    vectors = {i: _unit(terms, stem_of, factor, counted[i]) for i in mine.tolist()}
    full = [i for i, v in vectors.items() if len(v[0])]
    # Like examples share a block, which keeps the blocks' bounds tight.
    full.sort(key=lambda i: (labels[i], int(vectors[i][0][np.argmax(vectors[i][1])]), i))
    term = np.concatenate([vectors[i][0] for i in full] or [np.zeros(0, np.int64)])
    weight = np.concatenate([vectors[i][1] for i in full] or [np.zeros(0)])
    at = np.repeat(np.arange(len(full)), [len(vectors[i][0]) for i in full])
    order = np.lexsort((at, term))
    term, weight, at = term[order], weight[order].astype(np.float32), at[order]
    blocks = max(1, -(-len(full) // block))
    pair = term * blocks + at // block
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    prior = (ones + 0.5) / (n + 1)
    none = [i for i in mine.tolist() if i not in set(full)]
    empty = (float(y[none].sum()) + prior) / (len(none) + 1)
    index = ToxicityIndex(
        terms, stem_of, factor, np.array([keys[i] for i in full], object), y[full], at.astype(np.int32), weight, np.append(begin, len(at)).astype(np.int32), (at // block)[begin].astype(np.int32),
        np.maximum.reduceat(weight, begin) if len(begin) else np.zeros(0), np.searchsorted(term[begin], np.arange(len(terms) + 1)).astype(np.int32), blocks, block, neighbours, prior, float(empty), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    votes = [(index.vote(*index.nearest(*v)), y[i]) for i in held.tolist() if len((v := index.vector(counted[i]))[0])]
    if votes:
        index.grid, index.scores = _isotonic(*map(np.array, zip(*votes)))
    return index


def fold(key):
    """crc32 of the key as text, mod 5; fold 0 is held out (null keys too: they have no label)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5, F.lit(0))


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int, text_bytes: int) -> list:
    """(key, text, label) of the labelled rows outside fold 0, ``most`` at most, whole texts.

    Rows are ranked by a hash of their key (so the sample of a larger table is not its
    first rows); of a key with several rows or labels the smallest text and label count.
    Rows with longer texts than ``text_bytes`` are no examples.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    # The limit picks the keys before any text moves; the join then meets a bounded side.
    picked = documents.select(F.col(key).alias("k")).join(known, "k", "left_semi").distinct().orderBy(F.xxhash64("k"), "k").limit(most)
    chosen = F.broadcast(known.join(F.broadcast(picked), "k"))
    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("x")).where(F.octet_length("x") <= text_bytes).join(chosen, "k")
    return rows.groupBy("k", "y").agg(F.min("x").alias("x")).orderBy(F.xxhash64("k"), "k").collect()


def score_toxicity(documents: DataFrame, index: ToxicityIndex, text: str = "text", keep: list[str] | None = None, evidence: int = 3) -> DataFrame:
    """``keep`` columns (None: all), ``score``, and as ``evidence`` the keys, labels and cosines of the nearest examples.

    One row for each row, repeated ones too; null and empty texts get the score of texts
    without known terms and no evidence; an empty table gives no rows. Whole texts are
    read, one at a time; equal texts are scored once a batch. Rows are independent: no
    exchange. Columns named score or evidence are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(index)
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in ("score", "evidence")]
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])))])
    kind = pa.list_(pa.struct([("key", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        index = shared.value
        for batch in batches:
            done: dict[bytes, tuple] = {}
            scores, why = [], []
            for x in texts(batch.column(len(keep))):
                sign = x if len(x) <= 32 else blake2b(x, digest_size=16).digest()
                if sign not in done:
                    score, at, cosine = index.score(term_counts(x))
                    done[sign] = score, [{"key": str(index.keys[i]), "label": int(index.labels[i]), "cosine": c} for i, c in zip(at[:evidence].tolist(), cosine[:evidence].tolist())]
                score, because = done[sign]
                scores.append(score)
                why.append(because)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(why, kind)], [*keep, "score", "evidence"])

    return documents.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


#: Labelled rows that ``train`` fits on at most (of which a fifth calibrates), and the longest text of an example.
MOST_EXAMPLES, EXAMPLE_BYTES = 3000, 20_000


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_EXAMPLES, text_bytes: int = EXAMPLE_BYTES) -> ToxicityIndex:
    """``fit`` on ``labelled_sample``; at the default bounds under 60 MB reach the driver, 9 MB as a rule."""
    rows = labelled_sample(documents, labels, key, text, label, most, text_bytes)
    return fit([r.k for r in rows], [r.x.encode() for r in rows], [r.y for r in rows])
