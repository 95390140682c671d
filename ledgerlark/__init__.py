"""ledgerlark: invoice documents and training-data pipelines as declarative Spark plans."""
