"""Reducers of tool output: ``tools.REDUCERS`` names one for each profile."""
