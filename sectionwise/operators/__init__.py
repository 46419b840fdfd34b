"""Relational operators: noise filter, headings, numbering, chunks, layout, search, store."""
