"""Set-based operators on market events, books, fills and trades."""
