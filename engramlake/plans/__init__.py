"""Registered queries: an operator bound to the driver's tables plus its SQL oracle."""
