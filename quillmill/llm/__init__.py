"""Training-data operators: deduplication, extraction, classification, sharding and tokenization."""
