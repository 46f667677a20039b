from topicloom.sources.readers import dimension, register_view, scan_query, scan_table, select_view
from topicloom.sources.sinks import read_coordinates, write_coordinates, write_table

__all__ = [
    "dimension",
    "read_coordinates",
    "register_view",
    "scan_query",
    "scan_table",
    "select_view",
    "write_coordinates",
    "write_table",
]
