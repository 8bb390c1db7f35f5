"""Linear scorers of the conversion features with fixed coefficients."""

# Intercept and coefficients of each scorer, in training order.
SCORERS = {
    "recency": (1.0, {"days_since_signup": -0.03125}),
    "spending": (-1.0, {"orders_30d": 0.0625, "revenue_30d": 2.0 ** -20, "frequency_30d": 0.125}),
    "channels": (-0.5, {"pct_email": 1.0, "pct_direct": 0.5, "pct_organic": 0.25, "pct_ads": -0.5, "pct_social": -1.0}),
}
