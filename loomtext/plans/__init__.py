"""Query parsing and rewriting before any DataFrame exists."""
