"""Registered queries of the scalar, forecasting, regression and solver modules; importing a module registers its queries."""

from fathom.plans import calculus, chances, closed, dense, forecasts, learning, scalars, signals, solving, tensors  # noqa: F401
