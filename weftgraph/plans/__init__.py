"""Registered queries of the core library and their SQL equivalents."""
