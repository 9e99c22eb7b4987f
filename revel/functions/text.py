"""Column expressions over text: stripping, word splits, predicates, n-grams.

All of these are built-in Spark expressions (JVM side, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/strip() split on Unicode white space, so
# the Java patterns carry the (?U) flag.
WHITESPACE_RUN = r"(?U)\s+"
EDGE_WHITESPACE = r"(?U)^\s+|\s+$"
# Fixed value: string.ascii_letters + string.whitespace + string.punctuation
# as code-point ranges (tab..CR, space..'/', ':'..'~'); digits are excluded.
ASCII_TEXT_PATTERN = r"^[\x09-\x0d\x20-\x2f\x3a-\x7e]*\z"
# Fixed value: word tokens are runs of letters/digits or one other visible char.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """``str.strip()``: remove white space on both ends (Spark ``trim`` only drops blanks)."""
    return F.regexp_replace(_col(c), EDGE_WHITESPACE, "")


def words(c) -> Column:
    """``str.split()``: white-space runs separate words; never yields empty words."""
    return F.filter(F.split(_col(c), WHITESPACE_RUN), lambda t: t != F.lit(""))


def word_count(c) -> Column:
    return F.size(words(c))


def target_length(c, floor: int = 2) -> Column:
    """``max(2, number of words)``: generation length rule of the reference."""
    return F.greatest(F.lit(floor), word_count(c))


def is_ascii_text(c) -> Column:
    """Only ASCII letters, white space and punctuation; digits fail, empty passes."""
    return _col(c).rlike(ASCII_TEXT_PATTERN)


def tokens(c) -> Column:
    """Lower-cased word tokens (letters/digits runs and single punctuation marks)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def ngrams(word_array: str, n: int) -> Column:
    """All contiguous n-grams of a word-array *column*, each joined by one blank.

    Words never contain white space, so joining with a blank is injective for
    a fixed ``n`` and the n-grams compare as plain strings.  Pass a staged
    column name: the array is read inside the lambda once per element, which
    must be a field read, not a recomputation.
    """
    w = F.col(word_array)
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    # sequence() counts down on short rows, so guard before slicing.
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def run_starts(sorted_array: str) -> Column:
    """0-based positions where a new value starts in a sorted array (linear)."""
    s = F.col(sorted_array)
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def tag_occurrences(sorted_array: str, starts: str) -> Column:
    """Turn a multiset into a set: the k-th copy of ``x`` becomes ``x`` + U+0001 + k.

    ``sorted_array`` names a staged, sorted array column and ``starts`` its
    staged :func:`run_starts`.  Each run of equal values expands to its tagged
    copies, so the work is linear in the array length after the sort.  Then
    ``size(array_intersect(tag(a), tag(b)))`` is the multiset overlap
    ``sum_g min(count_a(g), count_b(g))`` (a hash intersect).
    """
    s, r = F.col(sorted_array), F.col(starts)
    n = F.size(s)
    per_run = F.transform(r, lambda st, j: F.transform(
        F.sequence(F.lit(0), F.coalesce(F.get(r, j + 1), n) - st - 1),
        lambda k: F.concat(F.get(s, st), F.lit("\u0001"), k.cast("string"))))
    return F.flatten(per_run)


def multiset_overlap(a_sorted: str, a_starts: str, b_sorted: str, b_starts: str) -> Column:
    return F.size(F.array_intersect(tag_occurrences(a_sorted, a_starts), tag_occurrences(b_sorted, b_starts)))


def split_sentences(c) -> Column:
    """Sentences the way the ROUGE package cuts them: split on '.', drop
    zero-length pieces, collapse inner white space (pieces of only blanks
    become empty strings and are kept)."""
    pieces = F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"\."), lambda p: F.length(p) > 0)
    return F.transform(pieces, lambda p: F.array_join(words(p), " "))


def sentence_words(sentences) -> Column:
    """Words of all sentences, split on single blanks (empty sentences give '')."""
    return F.flatten(F.transform(_col(sentences), lambda s: F.split(s, " ")))


def format_record(ground_truth, generated) -> Column:
    """One report record body (the sink adds the 40-dash separator)."""
    return F.concat(F.lit("Ground Truth: "), _col(ground_truth), F.lit("\nGenerated: "), _col(generated), F.lit("\n"))


# Fixed value: the reference's multi-record pattern (lazy texts, record ends at
# a dash line or the end of the text).
PAIR_PATTERN = r"(?s)Ground Truth:\s*(.*?)\s*\nGenerated:\s*(.*?)\s*(?:\n-+|$)"


def extract_pairs(df, blob: str):
    """All (ground truth, generated) matches in a text column, one row each, stripped."""
    refs = F.regexp_extract_all(F.col(blob), F.lit(PAIR_PATTERN), 1)
    gens = F.regexp_extract_all(F.col(blob), F.lit(PAIR_PATTERN), 2)
    z = df.select("*", F.inline(F.arrays_zip(refs.alias("r"), gens.alias("g"))))
    return z.select("*", strip("r").alias("reference"), strip("g").alias("generated")).drop("r", "g")
