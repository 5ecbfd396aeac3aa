"""Part of inkgrid."""
