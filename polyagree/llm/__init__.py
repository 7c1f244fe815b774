"""Training-data operators: tokens, near copies, quality, mixing, language, models, media, licences, packing.

Nothing else in the library imports this subpackage.
"""
