"""Training-data operators: dedup, decontamination, mixing, scoring, token output.

Nothing outside this package imports it.
"""
