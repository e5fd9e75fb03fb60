"""Training-data operators: ten self-contained components over text and vector tables.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus column names and returns a DataFrame; ``queries.py`` holds the thin
``opN_<name>`` wrappers that bind them to the published tables.
"""
