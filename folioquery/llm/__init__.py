"""Training-data operators: quality, privacy, packing, mixing, sharding, URLs, pages and near-duplicates."""
