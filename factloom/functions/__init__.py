"""Scalar functions and predicates as column builders."""
