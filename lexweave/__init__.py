"""lexweave: a Spark-native engine for subword-tokenizer analytics."""
