"""Operators of a training-data pipeline over `documents`, `pages` and `labels`. Nothing outside this folder imports it."""
