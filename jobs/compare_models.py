"""spark-submit job: tune all model families on the base table and rank them."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from featuretable import fixed_values as V  # noqa: E402
from featuretable.plans.modelling import compare  # noqa: E402
from featuretable.session import build_session  # noqa: E402
from featuretable.sources.scratch import remove_written  # noqa: E402
from featuretable.sources.tables import read_table, write_table  # noqa: E402
from jobs import common  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    options = common.parser("Tune and compare classifiers.")
    options.set_defaults(format="parquet")
    options.add_argument("--basetable", required=True)
    options.add_argument("--output", required=True, help="path of the leaderboard")
    options.add_argument("--folds", type=int, default=V.FOLDS)
    options.add_argument("--parallelism", type=int, default=4, help="grid points trained at once")
    args = options.parse_args(argv)
    spark = build_session("compare-models")
    table = read_table(spark, args.basetable, fmt=args.format)
    write_table(compare(table, folds=args.folds, parallelism=args.parallelism), args.output)
    remove_written(spark)


if __name__ == "__main__":
    main()
