"""Plans: named reports, the daily batch and the SQL oracles."""
