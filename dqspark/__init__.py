"""Data-quality operators for company contact data, as DataFrame -> DataFrame functions."""
