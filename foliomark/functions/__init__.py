"""Column functions: text cleaning, names, table rendering, fixed wording."""
