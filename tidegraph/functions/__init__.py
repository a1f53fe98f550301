"""Part of tidegraph; see README.md for the map of modules."""
