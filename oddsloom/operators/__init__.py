"""DataFrame operators over market, book, trade and settlement tables."""
