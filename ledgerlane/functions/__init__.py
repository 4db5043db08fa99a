"""Column functions: text, numbers, periods, codes and questions."""
