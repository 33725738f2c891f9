"""Reading and writing tables."""

from featuretable.sources.scratch import materialize, remove_written, scratch_path
from featuretable.sources.tables import read_table, write_table

__all__ = ["materialize", "remove_written", "read_table", "scratch_path", "write_table"]
