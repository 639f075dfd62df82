"""Part of cairn."""
