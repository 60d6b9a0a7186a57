"""Batch-by-batch processing: what happens when a new batch of rows arrives.

There are no continuous streams here; increments are batches numbered by id_sync.
"""
