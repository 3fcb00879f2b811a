"""radiolake: land-mobile-radio signalling analytics as Spark jobs."""
