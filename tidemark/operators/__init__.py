"""Ledger operators: functions from DataFrames to DataFrames. None collects rows, none reads a clock."""
