"""spark-submit job: the six JSON tables to Parquet, each parsed once.

The other jobs read the result with ``--format parquet`` and the paths under ``--output``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from featuretable.session import build_session  # noqa: E402
from featuretable.sources.tables import lines_by_file, read_lines, set_aside, write_table  # noqa: E402
from jobs import common  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    options = common.parser("Store the source tables as Parquet.")
    common.add_inputs(options)
    options.add_argument("--output", required=True, help="folder for one table per source")
    options.add_argument(
        "--malformed", help="folder for lines that do not fit the schema, and their number by file"
    )
    args = options.parse_args(argv)
    spark = build_session("ingest")
    output = args.output.rstrip("/")
    if args.malformed and args.format == "json":
        aside = args.malformed.rstrip("/")
        for name, schema in common.schemas(args).items():
            rows = read_lines(spark, getattr(args, name), schema)
            _, bad = set_aside(rows, f"{output}/{name}", f"{aside}/{name}")
            write_table(lines_by_file(bad), f"{aside}/{name}-files")
        return
    sources = common.read_sources(spark, args)
    for name in ("business", "checkin", "covid", "user", "review", "tip"):
        write_table(getattr(sources, name), f"{output}/{name}")


if __name__ == "__main__":
    main()
