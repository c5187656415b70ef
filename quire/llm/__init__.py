"""Operators for training data: term frequencies, repeated lines, defective pairs, scan noise,
markup residue, token ids, packing, truncation. Nothing outside this subpackage imports it."""
