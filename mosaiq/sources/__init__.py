"""Readers and writers of assay tables, and assays bound to the test schema."""

from .bindings import events_points, latent_assay, retail_cells, retail_counts, term_counts
from .tables import read_coordinates, read_counts, read_image, write_table

__all__ = ["events_points", "latent_assay", "read_coordinates", "read_counts", "read_image", "retail_cells", "retail_counts", "term_counts", "write_table"]
