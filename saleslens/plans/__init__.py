"""Structured queries and the table build, as lazy DataFrame plans."""
