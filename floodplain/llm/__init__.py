"""Operators for preparing training text: tokens, personal data, duplicates, licences, languages, leaks."""
