"""Whole computations: tessellations, solvent spheres, incremental updates."""
