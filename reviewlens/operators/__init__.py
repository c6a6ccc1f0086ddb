"""Analytics operators. Each takes DataFrames and returns a DataFrame; none runs a hidden full scan
on the driver."""
