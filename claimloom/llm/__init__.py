"""Operators of a training-data pipeline: extraction, joins, dedup, packing, tokens, archives.

Nothing else in the library imports this subpackage."""
