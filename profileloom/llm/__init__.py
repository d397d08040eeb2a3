"""Operators for preparing training text: filters, duplicate detection, mixing and tokenization."""
