"""Operators for preparing training corpora: one module per operator, plus the queries over the test tables."""
