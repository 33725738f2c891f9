"""Renaming, selecting and ordering columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame

from featuretable.functions.predicates import column


def replace_in_names(df: DataFrame, replacements: Mapping[str, str]) -> DataFrame:
    """Replace characters in all column names; two columns ending up alike is an error."""
    names = [
        reduce(lambda name, item: name.replace(*item), replacements.items(), name)
        for name in df.columns
    ]
    clashes = sorted(name for name, uses in Counter(names).items() if uses > 1)
    if clashes:
        raise ValueError(f"several columns would be called {clashes}")
    return df.toDF(*names)


def select_matching(df: DataFrame, part: str, extra: Iterable[str] = ()) -> DataFrame:
    """Columns whose name contains ``part``, then the ``extra`` ones."""
    matching = [name for name in df.columns if part in name]
    return keep(df, [*matching, *extra])


def keep(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, in that order."""
    return df.select(*[column(name) for name in names])


def drop(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """All but the named columns; names that are not there are ignored."""
    unwanted = set(names)
    return keep(df, [name for name in df.columns if name not in unwanted])


def key_first(df: DataFrame, key: str) -> DataFrame:
    """Move the key to the first position."""
    return keep(df, [key, *[name for name in df.columns if name != key]])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename single columns, old name to new name."""
    return df.withColumnsRenamed(dict(names))


def one_row_per_column(single: DataFrame, cells: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Lay a one-row result out as one row per described column.

    ``cells`` gives, for each described column, the source column of every measure.
    """
    rows = []
    for name, measures in cells.items():
        literal = name.replace("\\", "\\\\").replace("'", "\\'")
        listed = ", ".join(f"'{measure}', {source}" for measure, source in measures.items())
        rows.append(f"named_struct('column_name', '{literal}', {listed})")
    return single.selectExpr(f"inline(array({', '.join(rows)}))")
