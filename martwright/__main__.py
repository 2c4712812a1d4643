"""Batch entry point: build a mart from a folder of tables and write it.

    python -m martwright mart donor --tables DIR --out DIR [--format parquet|csv]
    python -m martwright mart churn --tables DIR --out DIR --as-of 2001-08-02 --after 1998-09-01
    python -m martwright segments bank --tables DIR --out DIR --k 3 \
        --features total_sum_trans,total_trans,days_since_last_trans,balance

(on a cluster: ship the package with ``spark-submit --py-files`` and run
this module's ``main``).

The tables folder holds one ``<name>.parquet`` per driver table.  The
session comes from the submit environment (master, executors, and the
shared ``spark.checkpoint.dir``); the library's runtime defaults are added
only where that configuration leaves them unset.
"""

from __future__ import annotations

import argparse

from .plans import bank, churn, donor
from .plans.catalog import tables
from .session import get_spark
from .sources.files import write_csv, write_parquet


def build(kind: str, spark, tables_dir: str, args) -> object:
    if kind == "donor":
        c, o = tables(spark, tables_dir, "customer", "orders")
        return donor.donor_mart(c, o, cutoff=args.cutoff or donor.CUTOFF,
                                campaign_end=args.campaign_end or donor.CAMPAIGN_END)
    if kind == "bank":
        c, n, r, li, o = tables(spark, tables_dir, "customer", "nation", "region", "lineitem", "orders")
        return bank.bank_mart(c, n, r, li, o, eval_date=args.eval_date or bank.EVAL_DATE)
    if kind == "churn":
        o, li, p, ev, c, n, r = tables(spark, tables_dir, "orders", "lineitem", "part", "events",
                                       "customer", "nation", "region")
        return churn.churn_mart(o, li, p, ev, c, n, r, as_of_date=args.as_of or churn.AS_OF,
                                after=args.after)
    raise ValueError(kind)


def segments(mart, features, k: int, seed: int = 1):
    """Winsorise the top 1 %, standardise, k-means, centres back in
    original (winsorised) units: ``(assigned rows, centres)``."""
    from .operators.encode import winsorize, zscore_fit, zscore_inverse, zscore_transform
    from .operators.train import kmeans_segments
    w = winsorize(mart, features, upper=0.01, suffix="_w")
    wc = [f"{c}_w" for c in features]
    st = zscore_fit(w, wc).first().asDict()
    z = zscore_transform(w, st, wc)
    assigned, centres = kmeans_segments(z, [f"{c}_z" for c in wc], k=k, seed=seed)
    back = zscore_inverse(centres, st, wc, suffix="_z", out_suffix="_centre")
    return assigned, back.select("cluster", "size", *[f"{c}_centre" for c in wc])


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="martwright")
    sub = ap.add_subparsers(dest="cmd", required=True)
    m = sub.add_parser("mart", help="build one mart and write it")
    m.add_argument("kind", choices=["donor", "bank", "churn"])
    m.add_argument("--tables", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    m.add_argument("--sep", default=",")
    m.add_argument("--cutoff")
    m.add_argument("--campaign-end")
    m.add_argument("--eval-date")
    m.add_argument("--as-of")
    m.add_argument("--after")
    sg = sub.add_parser("segments", help="k-means segments of a mart; rows and centres")
    sg.add_argument("kind", choices=["donor", "bank", "churn"])
    sg.add_argument("--tables", required=True)
    sg.add_argument("--out", required=True)
    sg.add_argument("--features", required=True, help="comma-separated mart columns")
    sg.add_argument("--k", type=int, default=3)
    sg.add_argument("--seed", type=int, default=1)
    for a in ("--cutoff", "--campaign-end", "--eval-date", "--as-of", "--after"):
        sg.add_argument(a)
    args = ap.parse_args(argv)
    spark = get_spark()
    df = build(args.kind, spark, args.tables, args)
    if args.cmd == "segments":
        assigned, centres = segments(df, args.features.split(","), args.k, args.seed)
        write_parquet(assigned, f"{args.out.rstrip('/')}/rows")
        write_csv(centres.coalesce(1), f"{args.out.rstrip('/')}/centres")  # k rows
        return
    if args.format == "csv":
        write_csv(df, args.out, sep=args.sep)
    else:
        write_parquet(df, args.out)


if __name__ == "__main__":
    main()
