"""Operators for the preparation of training corpora; nothing outside this subpackage imports it."""
