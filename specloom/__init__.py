"""A declarative mapping engine on PySpark: specifications in, DataFrame plans out."""
