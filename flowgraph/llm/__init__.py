"""Training-data operators: tokenising, mixing, sharding, search, joins and filters over text corpora."""
