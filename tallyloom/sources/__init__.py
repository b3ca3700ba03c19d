"""Readers: one function a format, from paths to bronze DataFrames, and a registry."""

from .registry import FORMATS, detect, detect_format, read_statement, register, scan

__all__ = ["FORMATS", "detect", "detect_format", "read_statement", "register", "scan"]
