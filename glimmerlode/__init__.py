"""glimmerlode: a PySpark-native analytics engine for corpus-scale static triage."""
