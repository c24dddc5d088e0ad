"""Forecasters: ``fit(DataFrame)`` returns a fitted forecaster, ``transform`` adds ``pred``."""
