"""Analytics over versioned, multi-table data, as DataFrame plans."""
