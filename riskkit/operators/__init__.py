"""Relational operators: DataFrame -> DataFrame functions and ML stages."""
