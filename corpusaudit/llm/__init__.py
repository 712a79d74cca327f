"""Operators for training corpora: counting, filtering, deduplication, scoring, mixing and writing of documents."""
