"""Training-data operators: token counts, dedup, quality, mixing and friends.

Nothing outside this package imports it; it can be deleted as a whole.
"""
