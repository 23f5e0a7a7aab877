"""Readers and writers of rollouts, metric logs, dumps and datasets."""
