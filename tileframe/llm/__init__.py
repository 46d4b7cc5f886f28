"""Operators for preparing training text: decontamination, tokenising, search, sharding, near copies, filters, scoring."""
