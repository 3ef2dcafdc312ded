"""The same period split over a stream."""
