"""Training-data operators: quality, duplicates, mixing, packing, privacy, licences.

Nothing else in the library imports this subpackage.
"""
