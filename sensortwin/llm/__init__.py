"""Training-data operators: toxicity, secrets, HTML text, suffix-array dedup, fingerprints, BPE,
token counts, n-gram Jaccard join, WARC archives and benchmark decontamination.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
