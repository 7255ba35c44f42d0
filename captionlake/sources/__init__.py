"""Readers and writers of subtitles, media and configuration."""
