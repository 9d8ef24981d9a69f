"""Training-data operators (formatting, packing, de-duplication, filtering, tokens, sharding).

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
