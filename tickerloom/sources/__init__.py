"""Inputs and outputs: driver tables, landed payloads, the observation store."""
