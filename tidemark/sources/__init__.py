"""Series sources: tables, event tables, CSV."""
