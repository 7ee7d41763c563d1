"""Operators for building training data: each module holds one operator; ``queries`` names them for the driver."""
