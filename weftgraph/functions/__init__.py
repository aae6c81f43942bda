"""Part of weftgraph; see README."""
