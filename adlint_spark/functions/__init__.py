"""Column functions: value formats, URLs, versions, macros."""
