"""Region analysis of binarised images on Spark, and corpus operators in ``llm``."""
