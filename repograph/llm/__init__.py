"""Training-data operators: search, privacy, tokens, media, joins, packing, quality, archives.

Nothing outside this folder imports it.  Each module holds one operator with a general
interface; ``queries`` binds the operators to the tables of the testbed and ``oracles``
holds the SQL of those that SQL can express.
"""
