"""tidemark: review-complaint analytics over time, expressed as Spark DataFrame operators."""
