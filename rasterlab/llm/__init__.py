"""Corpus operators for training data: each works on DataFrames of documents, pages or conversations."""
