"""Siltstone: hybrid retrieval, self-tuning analytics and lifecycle operators over DataFrames of text memories."""
