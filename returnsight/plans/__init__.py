"""Composed plans: feature build, preparation, models and explanation."""
