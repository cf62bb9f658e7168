"""Training-data operators: tokenisation, media, quality, dedup, safety, mixing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the folder is there.
"""
