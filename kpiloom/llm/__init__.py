"""Training-data operators: near-duplicate removal, WARC archives, sharding, mixing,
quality, language identification, token files and byte-pair encoding.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
