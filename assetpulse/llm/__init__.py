"""Operators of training-data pipelines: filters, scans, near duplicates, decontamination, mixing and sharding."""
