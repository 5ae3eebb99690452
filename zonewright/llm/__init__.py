"""Training-data operators: mixing, quality, sharding, packing, counts, search and near-duplicates.

Nothing outside this subpackage imports it.
"""
