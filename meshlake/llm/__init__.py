"""Operators for preparing training data for language models at corpus scale."""
