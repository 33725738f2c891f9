"""spark-submit job: six source tables to the base table."""

from __future__ import annotations

import os
import sys
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from featuretable.operators.assemble import require_unique  # noqa: E402
from featuretable.operators.filters import drop_incomplete  # noqa: E402
from featuretable.operators.impute import loss_report  # noqa: E402
from featuretable.plans.basetable import fill_gaps, raw_basetable  # noqa: E402
from featuretable.session import build_session  # noqa: E402
from featuretable.sources.scratch import materialize, remove_written  # noqa: E402
from featuretable.sources.tables import FORMATS, write_table  # noqa: E402
from jobs import common  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    options = common.parser("Build the base table.")
    common.add_inputs(options)
    options.add_argument("--output", required=True)
    options.add_argument("--output-format", default="parquet", choices=FORMATS)
    options.add_argument(
        "--allow-repeats", action="store_true", help="accept repeated business or user keys"
    )
    args = options.parse_args(argv)
    spark = build_session("build-basetable")
    sources = common.read_sources(spark, args)
    if not args.allow_repeats:
        require_unique(sources.business, "business_id")
        require_unique(sources.user, "user_id")
        sources = replace(sources, unique_users=True)
    raw = raw_basetable(
        sources, common.reference_days(args.reference_day), store_rollups=True
    )
    # One row per business: stored once for the report and for the table.
    filled = fill_gaps(materialize(raw, "raw-basetable"))
    write_table(loss_report(filled), f"{args.output.rstrip('/')}-losses", args.output_format)
    write_table(drop_incomplete(filled), args.output, args.output_format)
    remove_written(spark)


if __name__ == "__main__":
    main()
