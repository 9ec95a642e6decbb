"""Registered queries: compositions of adapters and operators, with DuckDB SQL beside them."""
