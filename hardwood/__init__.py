"""Basketball box-score and play-by-play analytics expressed as Spark DataFrame plans."""
