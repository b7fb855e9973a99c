"""Part of newsloom; see the README."""
