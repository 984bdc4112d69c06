"""Evidence synthesis over scientific literature as Spark DataFrame operators."""
