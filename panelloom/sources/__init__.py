from panelloom.sources import crosswalks, sinks, tables, wide

__all__ = ["crosswalks", "sinks", "tables", "wide"]
