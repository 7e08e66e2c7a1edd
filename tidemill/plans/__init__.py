"""Stages in order, each a plan over tables."""
