"""Operators for large training-data pipelines: dedup, token files, scoring, media, WARC and mixing."""
