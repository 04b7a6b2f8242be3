"""Training-data operators: ten corpus-cleaning steps over whole tables.

Nothing outside this subpackage imports it; it can be removed as one folder.
"""
