"""Fact tables to one row per entity.

Every rollup groups with partial aggregation before the shuffle, so an entity that holds a large
part of the facts sends only one row per task. Dates should be date or timestamp typed: the maximum
of a fixed-width value stays in the hash aggregate, that of a string does not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.dates import recency_months
from featuretable.functions.predicates import column
from featuretable.sources.scratch import materialize


def activity_state(
    facts: DataFrame, entity: str, date: str, parsed: Column | None = None
) -> DataFrame:
    """Facts with a date and the latest one, per entity; states of several loads can be merged.

    Where dates are text, ``parsed`` is their value: a text that is no date still counts as a fact.
    """
    return facts.groupBy(column(entity)).agg(
        F.count(column(date)).alias("_n"),
        F.max(column(date) if parsed is None else parsed).alias("_latest"),
    )


def merge_activity(states: DataFrame, entity: str) -> DataFrame:
    """One state per entity of the states of several loads, put together by ``unionByName``."""
    return states.groupBy(column(entity)).agg(F.sum("_n").alias("_n"), F.max("_latest").alias("_latest"))


def finish_activity(
    state: DataFrame, entity: str, reference: str | Column, count_as: str, recency_as: str
) -> DataFrame:
    return state.select(
        column(entity),
        F.col("_n").alias(count_as),
        recency_months(reference, F.col("_latest")).alias(recency_as),
    )


def rollup_activity(
    facts: DataFrame,
    entity: str,
    date: str,
    reference: str | Column,
    count_as: str,
    recency_as: str,
    parsed: Column | None = None,
) -> DataFrame:
    """Number of facts with a date and whole months since the latest one."""
    state = activity_state(facts, entity, date, parsed)
    return finish_activity(state, entity, reference, count_as, recency_as)


def member_state(
    facts: DataFrame, entity: str, member: str, date: str, sources: Sequence[str], count_of: str
) -> DataFrame:
    """Facts reduced to one row per (entity, member); states of several loads can be merged.

    That shuffle carries the distinct count as well, spreads a hot entity over its members and a hot
    member over its entities, and leaves far less to send through the join with the members.
    """
    partials = []
    for i, name in enumerate(sources):
        partials += [F.sum(column(name)).alias(f"_sum{i}"), F.count(column(name)).alias(f"_n{i}")]
    return facts.groupBy(column(entity), column(member)).agg(
        *partials,
        F.count(F.lit(1)).alias("_facts"),
        F.count(column(count_of)).alias("_counted"),
        F.max(column(date)).alias("_latest"),
    )


def merge_members(states: DataFrame, entity: str, member: str) -> DataFrame:
    """One state per (entity, member) of the states of several loads, put together by ``unionByName``."""
    added = [c for c in states.columns if c not in (entity, member, "_latest")]
    return states.groupBy(column(entity), column(member)).agg(
        *(F.sum(c).alias(c) for c in added), F.max("_latest").alias("_latest")
    )


def finish_members(
    pairs: DataFrame,
    members: DataFrame,
    entity: str,
    member: str,
    reference: str | Column,
    fact_averages: Mapping[str, str],
    member_averages: Mapping[str, str],
    count_as: str,
    distinct_as: str,
    recency_as: str,
    unique_members: bool = False,
) -> DataFrame:
    """The rollup of :func:`rollup_with_members` from the reduced facts.

    Both sides of the join are plain shuffles, so that adaptive execution can split a hot member:
    members are joined as they are if they are known to be unique (``require_unique``), and are
    reduced and stored first if not.
    """
    wanted = list(dict.fromkeys(member_averages.values()))
    if unique_members:
        present = [column(name).isNotNull().cast("long") for name in wanted]
        per_member = [F.lit(1).cast("long").alias("_rows")]
        for i, name in enumerate(wanted):
            per_member += [column(name).alias(f"_m_sum{i}"), present[i].alias(f"_m_n{i}")]
        known = members.select(column(member), *per_member)
    else:
        per_member = [F.count(F.lit(1)).alias("_rows")]
        for i, name in enumerate(wanted):
            per_member += [F.sum(column(name)).alias(f"_m_sum{i}"), F.count(column(name)).alias(f"_m_n{i}")]
        known = materialize(members.groupBy(column(member)).agg(*per_member), "members")
    joined = pairs.join(known, member, "left")

    times = F.coalesce("_rows", F.lit(1))
    totals = [
        F.try_divide(F.sum(F.col(f"_sum{i}") * times), F.sum(F.col(f"_n{i}") * times)).alias(name)
        for i, name in enumerate(fact_averages)
    ]
    facts_of = F.col("_facts")
    for name, source in member_averages.items():
        i = wanted.index(source)
        value, n = F.col(f"_m_sum{i}") * facts_of, F.col(f"_m_n{i}") * facts_of
        totals.append(F.try_divide(F.sum(value), F.sum(n)).alias(name))
    grouped = joined.groupBy(column(entity)).agg(
        *totals,
        F.sum(F.col("_counted") * times).alias(count_as),
        F.count(column(member)).alias(distinct_as),
        F.max("_latest").alias("_latest"),
    )
    return grouped.withColumn(
        recency_as, recency_months(reference, F.col("_latest"))
    ).drop("_latest")


def rollup_with_members(
    facts: DataFrame,
    members: DataFrame,
    entity: str,
    member: str,
    date: str,
    reference: str | Column,
    fact_averages: Mapping[str, str],
    member_averages: Mapping[str, str],
    count_of: str,
    count_as: str,
    distinct_as: str,
    recency_as: str,
    unique_members: bool = False,
) -> DataFrame:
    """Averages, counts and recency per entity, over facts written by members.

    Both mappings go from output name to input column. All averages and counts are those of the
    members joined to every fact: a member weighs as its facts, and one that the member table
    repeats weighs as often as it stands there. It is one member all the same in the distinct count.
    """
    pairs = member_state(facts, entity, member, date, list(fact_averages.values()), count_of)
    return finish_members(
        pairs, members, entity, member, reference, fact_averages, member_averages, count_as,
        distinct_as, recency_as, unique_members,
    )
