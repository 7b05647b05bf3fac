"""Part of foliant; see the README for the map of modules."""
