"""Catalog tables read from the driver's Parquet files."""
