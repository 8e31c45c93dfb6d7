"""Corpus preparation for language-model training: filters, de-duplication, models and mixing."""
