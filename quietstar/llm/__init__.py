"""Operators for training corpora: filtering, de-duplication, decontamination and mixing of documents."""
