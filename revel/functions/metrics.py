"""Text-metric column expressions: sentence BLEU and ROUGE-1/2/L.

Formulas (pinned by hand-worked cases in tests/test_metrics.py):

* BLEU-N, single reference, uniform weights 1/N.  ``num_i`` = clipped
  n-gram matches, ``den_i = max(1, #hyp i-grams)``.  Zero if ``num_1 = 0``.
  Smoothing "method 4" (k = 5): walking i = 1..N, a zero ``num_i`` becomes
  ``ln(c) / (2**inc * 5)`` and ``inc`` grows by one -- only when the
  hypothesis has more than one word; terms still zero are left out of the
  geometric mean (unsmoothed: a zero precision counts as the smallest
  double, so the score is ~0).  Brevity penalty ``1`` if c > r, ``0`` if c = 0, else
  ``exp(1 - r/c)``.  Percent.
* ROUGE-N: sentences split on '.', n-grams as *sets*; p = overlap/|hyp|,
  r = overlap/|ref| (0 on empty), f = 2pr/(p+r+1e-8).  Percent.
* ROUGE-L (length mode, default): LCS length over all words; p = LCS/#hyp
  words, r = LCS/#ref words.  Percent.  ``summary`` mode: the union-LCS of
  the ROUGE paper (per reference sentence, union of its LCS positions with
  every hypothesis sentence), over the same word totals.  ``set`` mode, as the
  scoring package has it: the *set of words* on the LCS of any reference
  sentence with any hypothesis sentence (of several LCS the one a walk back
  from the ends takes: a match first, then up if the score above is greater
  than the one on the left, else left); p over the distinct hypothesis words, r
  over the distinct reference words.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from revel.functions.text import multiset_overlap, ngrams, run_starts, sentence_words, split_sentences, words

# Fixed values of the metric definitions.
BLEU_SMOOTH_K = 5.0
# Without smoothing a zero precision is replaced by the smallest normal double
# (so its log is about -708 and the score all but vanishes).
LOG_FLOAT_MIN = math.log(sys.float_info.min)
ROUGE_F_EPS = 1e-8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bleu_count_stages(hyp_words: str, ref_words: str, n: int) -> list[dict[str, Column]]:
    """Projection stages computing ``_num1.._numN`` (clipped matches) and the
    lengths from two staged word-array columns; apply them with successive
    ``select``s so every lambda reads staged columns only.  Cost per row:
    one sort per n-gram order, then linear passes."""
    sorted_grams = {}
    for i in range(1, n + 1):
        sorted_grams[f"_hs{i}"] = F.array_sort(ngrams(hyp_words, i))
        sorted_grams[f"_rs{i}"] = F.array_sort(ngrams(ref_words, i))
    starts = {f"_hr{i}": run_starts(f"_hs{i}") for i in range(1, n + 1)}
    starts.update({f"_rr{i}": run_starts(f"_rs{i}") for i in range(1, n + 1)})
    nums = {f"_num{i}": multiset_overlap(f"_hs{i}", f"_hr{i}", f"_rs{i}", f"_rr{i}") for i in range(1, n + 1)}
    nums["_hyp_len"] = F.size(hyp_words)
    nums["_ref_len"] = F.size(ref_words)
    return [sorted_grams, starts, nums]


def bleu_from_counts(n: int, smooth: bool = True, prefix: str = "") -> Column:
    """Sentence BLEU-n (percent) from the columns made by :func:`bleu_counts`."""
    c = F.col(f"{prefix}_hyp_len").cast("double")
    rl = F.col(f"{prefix}_ref_len").cast("double")
    log_sum = F.lit(0.0)
    inc = F.lit(0)  # number of terms smoothed so far
    for i in range(1, n + 1):
        num = F.col(f"{prefix}_num{i}").cast("double")
        den = F.greatest(F.lit(1.0), c - (i - 1))
        if smooth:
            use = (num == 0) & (c > 1)
            smoothed = F.log(c) / (F.pow(F.lit(2.0), inc + 1) * F.lit(BLEU_SMOOTH_K))
            num = F.when(use, smoothed).otherwise(num)
            inc = inc + F.when(use, F.lit(1)).otherwise(F.lit(0))
        # smoothed: precisions still zero are left out; unsmoothed: float-min stands in
        zero_term = F.lit(0.0) if smooth else F.lit(LOG_FLOAT_MIN / n)
        log_sum = log_sum + F.when(num > 0, F.log(num / den) / float(n)).otherwise(zero_term)
    bp = F.when(c > rl, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1.0 - rl / c))
    return F.when(F.col(f"{prefix}_num1") == 0, F.lit(0.0)).otherwise(bp * F.exp(log_sum) * 100.0)


def rouge_words(text) -> Column:
    """Word list the ROUGE package scores (sentences split on '.')."""
    return sentence_words(split_sentences(text))


def rouge_scorable(hyp_text, ref_text) -> Column:
    """False where the package raises 'Hypothesis/Reference is empty'."""
    return (F.size(split_sentences(hyp_text)) > 0) & (F.size(split_sentences(ref_text)) > 0)


def _prf(overlap: Column, hyp_count: Column, ref_count: Column) -> dict[str, Column]:
    p = F.when(hyp_count == 0, F.lit(0.0)).otherwise(overlap / hyp_count)
    r = F.when(ref_count == 0, F.lit(0.0)).otherwise(overlap / ref_count)
    f = 2.0 * (p * r) / (p + r + F.lit(ROUGE_F_EPS))
    return {"p": p * 100.0, "r": r * 100.0, "f": f * 100.0}


def rouge_n(hyp_rwords: str, ref_rwords: str, n: int) -> dict[str, Column]:
    hg = F.array_distinct(ngrams(hyp_rwords, n))
    rg = F.array_distinct(ngrams(ref_rwords, n))
    overlap = F.size(F.array_intersect(hg, rg)).cast("double")
    return _prf(overlap, F.size(hg).cast("double"), F.size(rg).cast("double"))


def _lcs_one(a, b) -> int:
    """LCS length by the bit-vector recurrence (Allison-Dix / Hyyro):
    one big-integer step per hypothesis word instead of a quadratic table."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence length of two word arrays (Arrow batches)."""
    return pd.Series([_lcs_one(x, y) for x, y in zip(a, b)], dtype="int64")


def _lcs_positions(a, b) -> set[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``
    (dynamic program, backtracking up before left on ties)."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        ai, row, nxt = a[i], t[i], t[i + 1]
        for j in range(m):
            nxt[j + 1] = row[j] + 1 if ai == b[j] else max(row[j + 1], nxt[j])
    pos, i, j = set(), n, m
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            pos.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return pos


def _union_lcs_one(ref_sents, hyp_sents) -> int:
    """Summary-level LCS (Lin 2004): for every reference sentence, the union of
    its LCS word positions with each hypothesis sentence; summed."""
    if ref_sents is None or hyp_sents is None:
        return 0
    hyp = [list(h.split(" ")) for h in hyp_sents]
    total = 0
    for r in ref_sents:
        rw = r.split(" ")
        hit: set[int] = set()
        for hw in hyp:
            hit |= _lcs_positions(rw, hw)
        total += len(hit)
    return total


def _lcs_rows(a: list, masks: dict[str, int], b: list) -> list[int]:
    """Bit rows of the LCS table of ``a`` with each prefix of ``b``: bit i of row j is 0
    where the score grows from ``a[:i]`` to ``a[:i + 1]``."""
    full = (1 << len(a)) - 1
    rows = [full]
    for w in b:
        v = rows[-1]
        u = v & masks.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lcs_words(a: list, masks: dict[str, int], b: list) -> set[str]:
    """Words on the LCS that the walk back through the bit rows takes."""
    rows = _lcs_rows(a, masks, b)
    i, j, found = len(a), len(b), set()
    score = len(a) - rows[j].bit_count()
    while i and j and score:
        if a[i - 1] == b[j - 1]:
            found.add(a[i - 1])
            i, j, score = i - 1, j - 1, score - 1
        elif rows[j] >> (i - 1) & 1 and i - (rows[j - 1] & ((1 << i) - 1)).bit_count() < score:
            i -= 1  # as good above, less on the left
        else:
            j -= 1
            score = i - (rows[j] & ((1 << i) - 1)).bit_count()
    return found


def _set_lcs_one(ref_sents, hyp_sents) -> int:
    if ref_sents is None or hyp_sents is None:
        return 0
    hyp = [h.split(" ") for h in hyp_sents]
    found: set[str] = set()
    for r in ref_sents:
        a = r.split(" ")
        masks: dict[str, int] = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | (1 << i)
        for h in hyp:
            # nothing new can come from a pair whose common words are all there
            if not masks.keys() & set(h) <= found:
                found |= _lcs_words(a, masks, h)
    return len(found)


@pandas_udf(T.LongType())
def set_lcs(ref_sents: pd.Series, hyp_sents: pd.Series) -> pd.Series:
    """Number of distinct words on the LCS of any two sentences (Arrow batches)."""
    return pd.Series([_set_lcs_one(r, h) for r, h in zip(ref_sents, hyp_sents)], dtype="int64")


@pandas_udf(T.LongType())
def union_lcs(ref_sents: pd.Series, hyp_sents: pd.Series) -> pd.Series:
    """Summary-level union-LCS count of two sentence arrays (Arrow batches)."""
    return pd.Series([_union_lcs_one(r, h) for r, h in zip(ref_sents, hyp_sents)], dtype="int64")


# Ship this module's Python helpers by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rouge_l(hyp_rwords, ref_rwords, lcs: Column | None = None) -> dict[str, Column]:
    h, r = _col(hyp_rwords), _col(ref_rwords)
    if lcs is None:
        lcs = lcs_length(r, h)
    return _prf(lcs.cast("double"), F.size(h).cast("double"), F.size(r).cast("double"))


__all__ = ["bleu_count_stages", "bleu_from_counts", "rouge_n", "rouge_l", "rouge_words", "rouge_scorable", "lcs_length", "set_lcs", "words"]
