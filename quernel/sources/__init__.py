"""Readers that turn raw input into typed DataFrames."""
