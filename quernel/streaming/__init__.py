"""Operators over tables that keep growing."""
