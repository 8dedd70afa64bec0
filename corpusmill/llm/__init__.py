"""Operators for preparing training data: mixing, deduplication, filters, scans, counts and archives."""
