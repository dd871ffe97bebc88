from .jsonl import duplicates, field_values_of, load, read_jsonl, round_trip, schema_profile, write_jsonl

__all__ = ["duplicates", "field_values_of", "load", "read_jsonl", "round_trip", "schema_profile", "write_jsonl"]
