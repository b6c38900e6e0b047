"""Training-data operators: search, filtering, deduplication, packing and token output.

Nothing else in the library imports this subpackage. The modules hold general operators;
``queries`` binds each of them to the tables it is meant for.
"""
