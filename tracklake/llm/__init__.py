"""Training-data operators: mixing, dedup, quality, decontamination, licences, secrets.

Nothing outside this subpackage imports it.
"""
