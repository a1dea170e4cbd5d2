"""How plans are run: scratch tables and registered queries."""
