"""Training-data operators: packing, decontamination, licences, WARC, URL filters, near
duplicates, sharding, quality ranking, exact search and language-model scoring.

Nothing outside this subpackage imports it.
"""
