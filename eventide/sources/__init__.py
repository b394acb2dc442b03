from eventide.sources.tables import (events_raw, lineitem_raw, read_table, shifts, splits,
                                     stay_detail)

__all__ = ["events_raw", "lineitem_raw", "read_table", "shifts", "splits", "stay_detail"]
