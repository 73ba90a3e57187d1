"""Operators for preparing training text at scale.

Thirteen DataFrame operators (language identification, media columns, benchmark
decontamination, similarity join, language-model scoring, packing, private
data, toxicity, sharding, token files, byte-level BPE, fill-in-the-middle,
centroid clusters).  Nothing outside this folder imports
them.
"""
