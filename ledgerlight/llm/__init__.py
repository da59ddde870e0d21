"""Training-data operators: ten first-class components over documents and pages.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries and their SQL.
"""
