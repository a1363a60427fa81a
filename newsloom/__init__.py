"""Transcript segmentation analytics on Spark."""
