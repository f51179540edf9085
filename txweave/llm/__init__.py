"""Operators for preparing training corpora: deduplication, filtering, mixing and packing."""
