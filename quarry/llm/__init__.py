"""Operators for training-data pipelines: dedup, tokenizing, licenses, media, url filters, search, packing, quality, chat."""
