"""Dialogue-text extraction, restructuring and re-import as Spark dataflows."""
