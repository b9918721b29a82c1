"""Spark-native data-structure analytics: ordered sets, streams, geo, bitmaps, sketches, vectors and CRDTs as DataFrame operators."""
