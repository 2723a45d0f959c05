"""Operators for text that feeds model training. Nothing outside this folder imports it."""
