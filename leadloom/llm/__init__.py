"""Training-data operators: sharding, extraction, toxicity, licences, dedup, decontamination, chat, tokenisation.

Nothing outside this subpackage imports it. ``registry`` names the queries that the entry module adds.
"""
