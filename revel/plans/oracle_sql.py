"""DuckDB SQL fragments for the correctness oracle.

The oracle computes every metric a second, independent way (n-gram counts by
``unnest`` + ``GROUP BY``; LCS by a row-by-row dynamic program over lists),
so agreement with the Spark expressions is a real check, not a restatement.
"""

from __future__ import annotations

import math
import sys

LOG_FLOAT_MIN = math.log(sys.float_info.min)


def words(x: str) -> str:
    """str.split(): white-space runs, no empty words."""
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t_: t_ <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ngrams(w: str, n: int | str) -> str:
    return f"list_transform(range(1, len({w}) - {n} + 2), lambda i_: array_to_string({w}[i_:i_ + {n} - 1], ' '))"


def rouge_words(x: str) -> str:
    sents = (f"list_transform(list_filter(string_split(coalesce({x}, ''), '.'), lambda p_: length(p_) > 0), "
             f"lambda p_: array_to_string({words('p_')}, ' '))")
    return f"flatten(list_transform({sents}, lambda s_: string_split(s_, ' ')))"


def rouge_sentence_count(x: str) -> str:
    return f"len(list_filter(string_split(coalesce({x}, ''), '.'), lambda p_: length(p_) > 0))"


def lcs(a: str, b: str) -> str:
    """LCS length of word lists ``a`` (reference) and ``b`` (hypothesis).

    Row recurrence: for hypothesis word x, new[L] = max(old[L], old[k-1] + 1)
    with k the last position <= L in ``a`` holding x (rows are non-decreasing,
    so the last match dominates).  ``P`` = positions of x in ``a``.
    """
    row = (f"lambda prev_, pos_: list_transform(range(1, len({a}) + 2), lambda j_: "
           f"CASE WHEN j_ = 1 THEN 0 ELSE greatest(prev_[j_], "
           f"coalesce(prev_[list_max(list_filter(pos_, lambda k_: k_ < j_))] + 1, 0)) END)")
    positions = f"list_transform({b}, lambda x_: list_filter(range(1, len({a}) + 1), lambda k_: {a}[k_] = x_))"
    init = f"list_transform(range(0, len({a}) + 1), lambda z_: 0)"
    return f"list_reduce({positions}, {row}, {init})[-1]"


def rouge_sentences(x: str) -> str:
    return (f"list_transform(list_filter(string_split(coalesce({x}, ''), '.'), lambda p_: length(p_) > 0), "
            f"lambda p_: array_to_string({words('p_')}, ' '))")


def lcs_word_set(a: str, b: str) -> str:
    """Words on the LCS of word lists ``a`` and ``b`` that a walk back takes (match, up if greater, else left).

    The table is filled cell by cell; a cell holds its score ``l`` and the words ``s`` of its own walk back, so the last cell
    has the answer.  A reduced list must have the type of its result, so words and places ride in cells as well."""
    cell = f"""CASE WHEN ({a})[e_[1].l] = y_[1].s[1] THEN struct_pack(l := p_[e_[1].l].l + 1, s := list_append(p_[e_[1].l].s, y_[1].s[1]))
                    WHEN r_[e_[1].l].l > p_[e_[1].l + 1].l THEN r_[e_[1].l] ELSE p_[e_[1].l + 1] END"""
    none = "struct_pack(l := 0::BIGINT, s := []::VARCHAR[])"
    places = f"list_transform(range(1, len({a}) + 1), lambda i_: [struct_pack(l := i_, s := []::VARCHAR[])])"
    row = f"list_reduce({places}, lambda r_, e_: list_append(r_, {cell}), [{none}])"
    steps = f"list_transform({b}, lambda w_: [struct_pack(l := 0::BIGINT, s := [w_])])"
    return f"list_reduce({steps}, lambda p_, y_: {row}, list_transform(range(0, len({a}) + 1), lambda z_: {none}))[-1].s"


def bleu_expr(n: int, smooth: bool = True, num: str = "num{i}", c: str = "c", r: str = "r") -> str:
    """BLEU-n (percent) from clipped counts num1..numN and lengths c, r."""
    terms = []
    zero_flags: list[str] = []
    for i in range(1, n + 1):
        ni = num.format(i=i)
        den = f"greatest(1, {c} - {i - 1})"
        if smooth:
            inc = " + ".join(["1"] + [f"(CASE WHEN {z} THEN 1 ELSE 0 END)" for z in zero_flags])
            z = f"({ni} = 0 AND {c} > 1)"
            val = f"(CASE WHEN {z} THEN ln({c}) / (pow(2, {inc}) * 5.0) ELSE {ni} END)"
            zero_flags.append(z)
        else:
            val = f"cast({ni} AS double)"
        zero = "0" if smooth else f"{LOG_FLOAT_MIN / n!r}"
        terms.append(f"(CASE WHEN {val} > 0 THEN ln({val} / {den}) / {float(n)} ELSE {zero} END)")
    bp = f"(CASE WHEN {c} > {r} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE exp(1.0 - cast({r} AS double) / {c}) END)"
    return f"(CASE WHEN {num.format(i=1)} = 0 THEN 0.0 ELSE {bp} * exp({' + '.join(terms)}) * 100.0 END)"


def pair_scores_sql(src: str, key: str = "pair_id", bleu: bool = True, rouge: bool = True,
                    smooth: bool = True, sets: bool = True) -> str:
    """CTEs scoring ``src(key, reference, generated)``; the last one is ``scored``
    with ``key``, bleu1, bleu4 (if ``bleu``), scorable and ROUGE-1/2/L f/p/r
    (if ``rouge``)."""
    ctes = [f"""sw AS (
  SELECT {key} AS k, {words('reference')} AS rw, {words('generated')} AS hw,
         {rouge_words('reference')} AS rrw, {rouge_words('generated')} AS hrw,
         {rouge_sentence_count('reference')} > 0 AND {rouge_sentence_count('generated')} > 0 AS scorable
  FROM {src})"""]
    cols = [f"sw.k AS {key}"]
    joins = []
    if bleu:
        ctes.append(f"""orders AS (SELECT unnest(range(1, 5)) AS n),
hg AS (SELECT k, n, g, count(*) AS cnt FROM (
         SELECT sw.k, o.n, unnest({ngrams('sw.hw', 'o.n')}) AS g FROM sw, orders o) GROUP BY k, n, g),
rg AS (SELECT k, n, g, count(*) AS cnt FROM (
         SELECT sw.k, o.n, unnest({ngrams('sw.rw', 'o.n')}) AS g FROM sw, orders o) GROUP BY k, n, g),
clip AS (SELECT hg.k, hg.n, sum(least(hg.cnt, rg.cnt)) AS num
         FROM hg JOIN rg ON hg.k = rg.k AND hg.n = rg.n AND hg.g = rg.g GROUP BY hg.k, hg.n),
cnts AS (
  SELECT sw.k, len(sw.hw) AS c, len(sw.rw) AS r,
         coalesce(max(clip.num) FILTER (WHERE clip.n = 1), 0) AS num1,
         coalesce(max(clip.num) FILTER (WHERE clip.n = 2), 0) AS num2,
         coalesce(max(clip.num) FILTER (WHERE clip.n = 3), 0) AS num3,
         coalesce(max(clip.num) FILTER (WHERE clip.n = 4), 0) AS num4
  FROM sw LEFT JOIN clip ON clip.k = sw.k GROUP BY sw.k, sw.hw, sw.rw)""")
        joins.append("JOIN cnts ON cnts.k = sw.k")
        cols += [f"{bleu_expr(1, smooth)} AS bleu1", f"{bleu_expr(4, smooth)} AS bleu4"]
    if rouge:
        # words on the LCS of each two sentences
        set_ctes = f"""sents AS (SELECT {key} AS k, {rouge_sentences('reference')} AS ra, {rouge_sentences('generated')} AS ha FROM {src}),
sides AS (SELECT k, string_split(a, ' ') AS a, string_split(b, ' ') AS b
          FROM (SELECT k, a, unnest(ha) AS b FROM (SELECT k, unnest(ra) AS a, ha FROM sents))),
common AS (SELECT k, len(list_distinct(flatten(list({lcs_word_set('a', 'b')})))) AS os FROM sides WHERE list_has_any(a, b) GROUP BY k),
""" if sets else "common AS (SELECT NULL::BIGINT AS k, 0 AS os WHERE false),\n"
        ctes.append(f"""rs AS (
  SELECT k,
         len(list_distinct({ngrams('hrw', 1)})) AS h1, len(list_distinct({ngrams('rrw', 1)})) AS r1,
         len(list_intersect(list_distinct({ngrams('hrw', 1)}), list_distinct({ngrams('rrw', 1)}))) AS o1,
         len(list_distinct({ngrams('hrw', 2)})) AS h2, len(list_distinct({ngrams('rrw', 2)})) AS r2,
         len(list_intersect(list_distinct({ngrams('hrw', 2)}), list_distinct({ngrams('rrw', 2)}))) AS o2,
         len(hrw) AS hl, len(rrw) AS rl, {lcs('rrw', 'hrw')} AS lcs
  FROM sw),
{set_ctes}rp AS (
  SELECT rs.k, CASE WHEN h1 = 0 THEN 0.0 ELSE coalesce(os, 0) / h1 END AS ps, CASE WHEN r1 = 0 THEN 0.0 ELSE coalesce(os, 0) / r1 END AS qs,
         CASE WHEN h1 = 0 THEN 0.0 ELSE o1 / h1 END AS p1, CASE WHEN r1 = 0 THEN 0.0 ELSE o1 / r1 END AS q1,
         CASE WHEN h2 = 0 THEN 0.0 ELSE o2 / h2 END AS p2, CASE WHEN r2 = 0 THEN 0.0 ELSE o2 / r2 END AS q2,
         CASE WHEN hl = 0 THEN 0.0 ELSE lcs / hl END AS pl, CASE WHEN rl = 0 THEN 0.0 ELSE lcs / rl END AS ql
  FROM rs LEFT JOIN common ON common.k = rs.k)""")
        joins.append("JOIN rp ON rp.k = sw.k")
        cols.append("sw.scorable")
        for name, p_, q_ in (("rouge_1", "p1", "q1"), ("rouge_2", "p2", "q2"), ("rouge_l", "pl", "ql"), ("rouge_l_set", "ps", "qs"))[:4 if sets else 3]:
            cols += [f"CASE WHEN sw.scorable THEN 200.0 * {p_} * {q_} / ({p_} + {q_} + 1e-8) END AS {name}_f",
                     f"CASE WHEN sw.scorable THEN 100.0 * {p_} END AS {name}_p",
                     f"CASE WHEN sw.scorable THEN 100.0 * {q_} END AS {name}_r"]
    ctes.append(f"scored AS (SELECT {', '.join(cols)} FROM sw {' '.join(joins)})")
    return ",\n".join(ctes)


TEXT_METRICS = ("bleu1", "bleu4") + tuple(f"{k}_{s}" for k in ("rouge_1", "rouge_2", "rouge_l", "rouge_l_set") for s in ("f", "p", "r"))


def report_agg_sql(scored: str = "scored", group: str | None = None, sets: bool = True) -> str:
    cols = [f"round(coalesce(avg({m}), 0), 6) AS {m}" for m in TEXT_METRICS if sets or "_set_" not in m]
    g = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return (f"SELECT {g}count(*) AS n_pairs, CAST(count_if(scorable) AS BIGINT) AS n_scorable, "
            + ", ".join(cols) + f" FROM {scored}{tail}")
