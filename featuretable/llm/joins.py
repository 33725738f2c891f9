"""Joins of wide text rows with narrow lists of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column

#: Rows of a narrow side (an id and a flag, about 50 bytes in memory) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def narrow(side: DataFrame) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, by a count of them.

    Beyond, it stays as it is and Spark shuffles both sides; the result is the same. ``side`` should be a
    stored table or cheap to count.
    """
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def wrapped(docs: DataFrame, doc_id: str) -> DataFrame:
    """``row`` with all columns of ``docs``, and ``id``: names in ``docs`` cannot clash with ours."""
    return docs.select(F.struct("*").alias("row"), column(doc_id).alias("id"))


def without(docs: DataFrame, doc_id: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (column ``id``); rows without an id stay."""
    return wrapped(docs, doc_id).join(narrow(ids), "id", "left_anti").select("row.*")
