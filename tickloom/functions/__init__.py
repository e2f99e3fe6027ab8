"""Column expressions: parsing, prices, fees, outcomes and labels."""
