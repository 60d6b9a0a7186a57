"""Whole jobs, as their users call them: frames in, one result row (or the training rows) out."""
