"""Feature tables and binary classifiers on Spark: lazy DataFrame-to-DataFrame operators."""
