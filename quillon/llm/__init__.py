"""Training-data operators: quality, filtering, media, mixing, tokenization and near-duplicate joins.

Nothing else in the library imports this subpackage; ``queries`` holds its query and SQL registry.
"""
