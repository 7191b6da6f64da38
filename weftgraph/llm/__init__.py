"""Operators for preparing large text corpora: each module holds one operator.

``queries`` registers the operators over the given tables; nothing outside imports this package.
"""
