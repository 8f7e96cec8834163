"""Operators for preparing text corpora: extraction, tokens, duplicates, secrets, chat, packing, search, quality."""
