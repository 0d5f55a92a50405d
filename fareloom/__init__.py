"""fareloom: a PySpark library for trip warehouses.

Load monthly files and a bounded event stream, conform both to one contract,
keep the latest copy of each trip, build daily and monthly marts, and publish a
table only after its quality gates have passed.
"""
