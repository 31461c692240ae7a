"""Sources and sinks: nested snapshot scans, partitioned tables, stores."""
