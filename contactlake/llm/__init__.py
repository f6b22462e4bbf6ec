"""Operators that prepare training text: rules, dedup, mixing, scans, formatting, encoding."""
