"""Training-data operators: quality, dedup, packing, toxicity, tokens, decontamination, chat, shards, language.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
