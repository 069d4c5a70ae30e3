"""Readers and writers for exports, logs, files, bundles and targets."""
