"""Operators of a training-data pipeline: quality, toxicity, WARC
derivatives, de-duplication, decontamination, language-model scores, mixing.

Nothing else in the library imports this subpackage.
"""
