"""Operators for large training corpora: extraction, fingerprints, search, mixing, archives, scoring, packing, joins."""
