"""Operators for building training corpora: cleaning, scoring, scanning, dedup, packing, sharding."""
