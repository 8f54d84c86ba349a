"""Operators for preparing training corpora at large scale; nothing outside this subpackage imports them."""
