"""See the package docstring in strandql."""
