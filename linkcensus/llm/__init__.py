"""Operations on training data: filters, deduplication, language models, tokens, shards.

Nothing else in the library imports this subpackage.
"""
