"""Column functions (Catalyst expressions) and Arrow functions for what expressions cannot say."""
