"""DataFrame operators: features, scaling, estimation, forecasting, validation, metrics, neural models."""
