"""Joins, folds, windows and kernels over tables keyed by file_id and seg_idx."""
