"""Operators on recordings, spectra, labels, calls, scores and tracks."""
