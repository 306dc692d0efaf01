"""Windowed analytics of behavioural and physiological recordings on Spark DataFrames."""
