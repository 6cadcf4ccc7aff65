"""textloom: full-text search and text processing on Spark DataFrames."""

VERSION = "0.1.0"
#: Version of the text analysis profile that index tables are built with.
PROFILE = 1


def version() -> dict[str, object]:
    """Version of the library and of the analysis profile."""
    return {"version": VERSION, "profile": PROFILE, "unicode": "16.0.0 (general path: that of the Python in use)"}
