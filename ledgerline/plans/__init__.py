"""Runs that join the operators end to end."""
