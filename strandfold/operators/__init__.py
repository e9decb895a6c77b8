"""Operators over tables of reads."""
