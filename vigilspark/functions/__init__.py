"""Part of vigilspark; see README.md."""
