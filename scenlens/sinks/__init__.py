from scenlens.sinks.writers import chart_table, map_table, report_table, write_report, write_table

__all__ = ["chart_table", "map_table", "report_table", "write_report", "write_table"]
