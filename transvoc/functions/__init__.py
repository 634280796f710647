"""See the package docstring of ``transvoc``."""
