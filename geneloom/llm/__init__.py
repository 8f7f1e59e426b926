"""Training-data operators. Nothing else in geneloom imports this subpackage."""
