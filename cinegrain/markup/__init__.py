"""Extractors that read encyclopedia markup into records; plain Python on one page, run over Arrow batches by ``udfs``."""
