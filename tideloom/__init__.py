"""Time-series preparation, fitting, forecasting and scoring on Spark DataFrames."""
