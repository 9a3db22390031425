"""Sources: CSV ingest, header tables, cell grids, row numbers, synthetic defects."""
