"""Operators for preparing training corpora: dedup, quality, mixing, tokens, language model scores, chat formatting."""
