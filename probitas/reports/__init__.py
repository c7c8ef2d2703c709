"""What comes out of a run: traces, tables of text, and plugins."""
