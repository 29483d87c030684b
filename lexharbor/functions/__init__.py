"""Part of lexharbor."""
