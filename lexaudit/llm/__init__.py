"""Training-data operators: scoring, sharding, mixing, tokenising and
deduplicating a document corpus. Nothing else in the library imports this
subpackage."""
