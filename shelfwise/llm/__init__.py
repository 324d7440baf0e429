"""Training-data operators: secret scan, deduplication, packing, language models, search.

Nothing else in the library imports this package; the driver's catalog adds its queries
only when the package is present.
"""
