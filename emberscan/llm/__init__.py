"""Operators for large text corpora: quality, near duplicates, packing, decontamination, archives, token files.

Nothing else in the library imports this folder. All rows reach Python in
Arrow batches; the helpers in ``words`` cut a batch into pieces of bounded
bytes before any array is made from it.
"""
