"""Analytics over operating-system trace data, expressed as Spark DataFrame plans."""

from tracelake.specs import TableSpec, register_counter, register_table, spec, table_names

__all__ = ["TableSpec", "register_counter", "register_table", "spec", "table_names"]
