"""Training-data operators: ten operators over documents and pages.

Nothing outside this package imports it; ``catalog`` lists its queries.
"""
