"""The query language: parsing, validation, wire form, and its Column plans."""
