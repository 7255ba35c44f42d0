"""Stages, checkpoints and whole pipelines."""
