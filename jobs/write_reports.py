"""spark-submit job: the standard reports, one small table each."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame  # noqa: E402

from featuretable.plans import exploration as X  # noqa: E402
from featuretable.plans.basetable import Sources, clean_business, tenure_table  # noqa: E402
from featuretable.session import build_session  # noqa: E402
from featuretable.sources.tables import read_table, write_table  # noqa: E402
from jobs import common  # noqa: E402


def reports(sources: Sources, table: DataFrame, reference_day: str) -> dict[str, DataFrame]:
    """Every report as a lazy table; ``table`` is the stored base table."""
    everything, clean = clean_business(sources.business, None), clean_business(sources.business)
    tenure = tenure_table(sources.user, "user_id", reference_day, sources.user_since)
    return {
        "business_per_category": X.businesses_per(everything, "categories"),
        "business_per_star": X.businesses_per(clean, "stars", order="key_desc"),
        "business_per_state": X.businesses_per(clean, "state"),
        "business_per_city": X.businesses_per(clean, "city"),
        "reviews_per_star": X.reviews_per_star(sources.review),
        "most_reviewed": X.most_reviewed(sources.review),
        "tips_per_compliments": X.tips_per_compliments(sources.tip),
        "most_tipped": X.most_tipped(sources.tip),
        "users_per_year": X.users_per_year(tenure),
        "takeout_before_after": X.takeout_before_after(table),
        "kids_before_after": X.kids_before_after(table),
        "new_deliveries": X.new_deliveries(table),
        "average_reviews_of_new_deliveries": X.average_reviews_of_new_deliveries(table),
        "share_by_price": X.share_by_price(table),
    }


def main(argv: list[str] | None = None) -> None:
    options = common.parser("Write the reports.")
    common.add_inputs(options)
    options.add_argument("--basetable", required=True, help="Parquet base table")
    options.add_argument("--output", required=True, help="folder for the reports")
    args = options.parse_args(argv)
    spark = build_session("write-reports")
    table = read_table(spark, args.basetable, fmt="parquet")
    found = reports(common.read_sources(spark, args), table, args.reference_day)
    for name, report in found.items():
        write_table(report, f"{args.output.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
