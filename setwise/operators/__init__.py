"""Set algebra, order statistics, indexes and statistics over relations of integers."""
