"""Sources and sinks: adapters of generic tables, CSV files, GeoTIFF tiles."""
