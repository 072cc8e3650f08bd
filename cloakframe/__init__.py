"""cloakframe: document pseudonymisation and training-data operators on Spark DataFrames."""
