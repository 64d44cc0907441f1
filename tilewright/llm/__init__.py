"""Operators for preparing training corpora: duplicates, packing, sharding, scans, language, quality, mixing, privacy."""
