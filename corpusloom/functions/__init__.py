"""Part of the curation engine; see the README for the map of modules."""
