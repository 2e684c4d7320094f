"""Training-data operators: ten ways to clean, match, count, mix and shard a document corpus."""
