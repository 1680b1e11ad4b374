"""Training-data operators: ten independent modules, their queries and their SQL.

Nothing outside this folder imports it (``__spark_entry__`` adds its queries
only where it can be imported).
"""
