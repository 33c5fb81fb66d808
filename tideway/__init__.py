"""Lead-lag analytics on Spark DataFrames, and operators for text corpora in the subpackage ``llm``."""
