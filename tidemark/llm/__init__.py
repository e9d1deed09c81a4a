"""Training-data operators: extraction, joins, scoring, mixing, sharding, tokens."""
