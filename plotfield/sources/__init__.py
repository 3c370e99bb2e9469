from plotfield.sources.tables import literal_table, read_table, read_wide

__all__ = ["literal_table", "read_table", "read_wide"]
