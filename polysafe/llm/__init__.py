"""Training-data operators (language id, near duplicates, packing, ...).

Nothing else in the library imports this subpackage; it may import general
helpers of the library (session, checkpoints).
"""
