"""Set algebra, order statistics, range and bit-sliced analytics as DataFrame plans."""
