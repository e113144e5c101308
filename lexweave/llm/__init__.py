"""Operators for preparing training data: filtering, deduplication, encoding, packing and archives."""
