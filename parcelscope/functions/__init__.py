"""Column expressions: cleaning, calendar, bands, formatting, tail probabilities."""
