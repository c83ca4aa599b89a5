"""All queries of the corpus operators."""

from panelscope.llm import centroids, decontaminate, filter_audit, jaccard, langid, lines, minhash, mixing, quality, repeats, sharding, urls, warc
from panelscope.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "centroids", "decontaminate", "filter_audit", "jaccard", "langid", "lines", "minhash", "mixing", "quality", "repeats", "sharding", "urls", "warc"]
