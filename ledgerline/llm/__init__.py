"""Operators for large training corpora; every module is DataFrame in, DataFrame out."""
