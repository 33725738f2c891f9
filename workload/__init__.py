"""The operators applied to the test tables, with the SQL each result is checked against."""
