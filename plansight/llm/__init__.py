"""Training-data operators: tokenising, scoring, deduplication, mixing, formatting and search.

Nothing else in the library imports this subpackage. Each module holds one operator with its
own general interface; :mod:`plansight.llm.queries` applies the operators to whole tables.
"""
