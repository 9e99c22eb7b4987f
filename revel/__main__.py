"""Command line: score an explanation report.

    python -m revel eval-report PATH [--rouge-l length|summary] [--master local[*]]

Reads the report (records of ``Ground Truth: ...`` / ``Generated: ...`` ended
by 40 dashes), drops pairs with an empty side, and prints BLEU-1/4 and
ROUGE-1/2/L averages with both denominators, like the reference's
evaluation script.
"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="revel")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ev = sub.add_parser("eval-report", help="BLEU / ROUGE averages of a report file or folder")
    ev.add_argument("path")
    ev.add_argument("--rouge-l", default="length", choices=["length", "summary"])
    ev.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from revel.operators.metrics import nonempty_pairs, pair_scores, text_report
    from revel.session import get_session
    from revel.sources.readers import read_report

    spark = get_session(args.master)
    rep = nonempty_pairs(read_report(spark, args.path))
    row = text_report(pair_scores(rep, rouge_l_mode=args.rouge_l)).first().asDict()
    if row["n_pairs"] == 0:
        print("No valid ground truth-generated pairs found.")
        return 1
    print(json.dumps({k: (round(v, 4) if isinstance(v, float) else v) for k, v in row.items()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
