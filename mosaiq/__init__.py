"""Learning across data modalities and corpus processing as Spark DataFrame operators."""
