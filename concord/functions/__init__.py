"""Part of concord."""
