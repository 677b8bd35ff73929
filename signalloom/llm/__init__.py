"""Operators that prepare training text: truncation, ranking, canonical form, privacy, duplicates,
tokenizer encoding, evaluation leakage and splitting.  Nothing else in the package imports this one."""
