"""Operators of a training-data pipeline: mixing, filters, labels, secrets, duplicates, media and token ids."""
