"""Operators for training corpora: repeats, quality, licences, leaks, mixing and token counts."""
