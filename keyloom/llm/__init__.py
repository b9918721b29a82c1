"""Operators of a training-data pipeline: packing, BPE, deduplication, quality, chat formatting and token counts."""
