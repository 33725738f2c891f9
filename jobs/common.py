"""Arguments and inputs shared by the jobs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from featuretable import fixed_values as V
from featuretable.plans.basetable import ReferenceDays, Sources
from featuretable.sources import tables as S

RAW_ATTRIBUTES = [
    name.replace("attributes_", "attributes.")
    for name in (
        *V.SIMPLE_FLAGS,
        *[source for _, source, _ in V.SPECIAL_FLAGS],
        V.PRICE,
        *V.UNUSED_ATTRIBUTES,
    )
]


def parser(description: str) -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(description=description)
    found.add_argument("--format", default="json", choices=S.FORMATS, help="format of the inputs")
    return found


def add_inputs(found: argparse.ArgumentParser) -> None:
    for name in ("business", "checkin", "covid", "user", "review", "tip"):
        found.add_argument(f"--{name}", required=True, help=f"path of the {name} table")
    found.add_argument("--since", required=True, help="join date column of the user table")
    found.add_argument("--reference-day", default=V.REFERENCE_DAY)


def schemas(args: argparse.Namespace) -> dict[str, StructType]:
    return {
        "business": S.business_schema(RAW_ATTRIBUTES),
        "checkin": S.checkin_schema(),
        "covid": S.covid_schema(),
        "user": S.user_schema(args.since),
        "review": S.review_schema(),
        "tip": S.tip_schema(),
    }


def read_sources(spark: SparkSession, args: argparse.Namespace) -> Sources:
    required = {
        "business": ["business_id", "categories", "city", "state", "stars"],
        "checkin": ["business_id", "date"],
        "covid": ["business_id", V.CLOSED, V.DELIVERY],
        "user": ["user_id", args.since, "average_stars", "fans", "review_count"],
        "review": ["business_id", "user_id", "date", "stars", "useful"],
        "tip": ["business_id", "date"],
    }
    read = {
        name: S.read_table(spark, getattr(args, name), schema, args.format, required[name])
        for name, schema in schemas(args).items()
    }
    return Sources(**read, user_since=args.since)


def reference_days(day: str) -> ReferenceDays:
    return ReferenceDays(checkin=day, review=day, tip=day, user=day)
