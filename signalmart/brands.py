"""The default entity dimension: twelve consumer brands in three categories.

Fixed values.  ``news_ticker`` is the spelling carried by news records, ``ticker``
the one used for quotes; the two differ, so neither is ever a join key.
"""

# brand, category, type, news ticker, quote ticker, exchange, news search terms, trend search term
DEFAULT_BRANDS = (
    ("Coca-Cola", "Beverages", "listed", "KO", "KO", "NYSE", ["Coca Cola India", "Coke India"], "Coca Cola India"),
    ("PepsiCo", "Beverages", "listed", "PEP", "PEP", "NYSE", ["Pepsi India", "PepsiCo India"], "Pepsi India"),
    ("Thums Up", "Beverages", "private", None, None, None, ["Thums Up"], "Thums Up"),
    ("Limca", "Beverages", "private", None, None, None, ["Limca drink India"], "Limca drink"),
    ("HUL", "Health", "listed", "HINDUNILVR", "HINDUNILVR.NS", "NSE", ["Hindustan Unilever", "HUL India"],
     "Hindustan Unilever"),
    ("Dabur", "Health", "listed", "DABUR", "DABUR.NS", "NSE", ["Dabur India"], "Dabur India"),
    ("Himalaya", "Health", "private", None, None, None, ["Himalaya Drug Company", "Himalaya herbals"],
     "Himalaya herbals"),
    ("Patanjali", "Health", "private", None, None, None, ["Patanjali products", "Patanjali India"],
     "Patanjali products"),
    ("ITC", "Snacks", "listed", "ITC", "ITC.NS", "NSE", ["ITC snacks India", "Bingo chips"], "ITC Bingo"),
    ("Haldirams", "Snacks", "private", None, None, None, ["Haldiram India", "Haldirams snacks"], "Haldiram India"),
    ("Kurkure", "Snacks", "private", None, None, None, ["Kurkure chips India"], "Kurkure chips"),
    ("Lays", "Snacks", "private", None, None, None, ["Lays India", "Lays chips India"], "Lays India"),
)
